"""Results of the operators that SQL cannot express against plain Python versions."""

import functools
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import SF, brute_symbols, check_shards, reference_encoding
from wareweave.llm import bpe, components, exact_dedup, licenses, perplexity, points, quality_cnn, registry, sharding, simhash, toxicity, url_filter


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"] or "", r["lang"]) for r in rows]


def grams(text, order=4):
    s = [0] * (order - 1) + brute_symbols(text)
    return [tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s))]


# op1: modified Kneser-Ney and the bands


def brute_points(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = lambda c: [ord(c)] if ord(c) < 1984 else [1984 + ord(c) // 1024, 3072 + ord(c) % 1024]
    s = [0, 0, 0, 0, *(x for w in words for x in (*(y for c in w for y in parts(c)), 0))]
    return [tuple(s[i - 4 : i + 1]) for i in range(4, len(s))]


def brute_kneser_ney(texts):
    """The probability of a 5-gram that the texts hold, by the order-five model."""
    seen, holders = Counter(), defaultdict(set)
    for t in texts:
        for g in brute_points(t):
            seen[g] += 1
            holders[g].add(t)
    levels = [Counter({g: n for g, n in seen.items() if len(holders[g]) > 1})]
    for _ in range(4):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    tables = []
    for counts in levels:
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        raw = [k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 0.5) for k in (1, 2, 3)]
        cut = [0, *(min(max(d, 0.1 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw, strict=True))]
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += cut[min(c, 3)]
        tables.append((counts, cut, total, left))

    @functools.cache
    def p(g):
        if not g:
            return 1 / 4096
        counts, cut, total, left = tables[len(g) - 1]
        if not total[g[:-1]]:
            return p(g[1:])
        c = counts[g]
        return (c - cut[min(c, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


ODD = ["", " \n ", " lead", "ab", "漢字 🎉\x00 ñ", "ab ab\n", "무선 마우스 블랙", "무선 마우스 화이트", "전부 같은 글", "전부 같은 글"] + ["tail and tale %d" % i for i in range(40)]


@pytest.mark.parametrize("hot", [0, 40, perplexity.HOT])
def test_costs_by_brute_force_whatever_is_broadcast(spark, hot):
    p = brute_kneser_ney(ODD)
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    model = perplexity.train(docs)
    frequent, others = perplexity.split(model, hot)
    assert frequent.count() <= hot and frequent.count() + others.count() == model.count() == len({g for t in ODD for g in brute_points(t)})
    for r in perplexity.score(docs, model, hot).collect():
        words = len(ODD[r["doc_id"]].split())
        want = sum(-math.log(p(g)) for g in brute_points(ODD[r["doc_id"]])) / words if words else None
        assert r["entropy"] == (pytest.approx(want, abs=1e-4) if words else None)


def test_stretches_join_without_seams(monkeypatch):
    want = [(np.concatenate(c), np.concatenate(r)) for c, r in [zip(*points.stretches(ODD), strict=True)]]
    monkeypatch.setattr(points, "STRETCH", 7)
    got = [(np.concatenate(c), np.concatenate(r)) for c, r in [zip(*points.stretches(ODD), strict=True)]]
    assert all((a == b).all() for a, b in zip(want[0], got[0], strict=True))
    codes = [sum(x << 12 * (4 - k) for k, x in enumerate(g)) for t in ODD for g in brute_points(t)]
    assert want[0][0].tolist() == codes


def test_perplexity_query_by_brute_force(spark, texts):
    found = {r["doc_id"]: r for r in registry.queries()["op1_perplexity"](spark, SF).collect()}
    p = brute_kneser_ney([t for _, t, _ in texts])
    entropy = {}
    for d, t, _ in texts:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        entropy[d] = sum(-math.log(p(g)) for g in brute_points(t)) / words if words else None
    for d, r in found.items():
        if entropy[d] is None or entropy[d] > 700:
            assert (r["perplexity"] is None) == (entropy[d] is None)
        else:
            assert math.log(r["perplexity"]) == pytest.approx(entropy[d], abs=1e-3)
    bins = defaultdict(set)
    for d, t, lang in texts:
        if not found[d]["base_failed"]:
            bins[lang].add((t, round(math.log(found[d]["perplexity"]) * 1000)))
    for d, _, lang in texts:
        values = sorted(b for _, b in bins[lang])
        q1, q2, q3 = (values[math.ceil(q * len(values)) - 1] / 1000 for q in (0.25, 0.5, 0.75))
        low, high = (q2 - max(0.03, (q2 - q1) / 0.6745 * 4.5), q2 + max(0.03, (q3 - q2) / 0.6745 * 4.5))
        r = found[d]
        assert (r["perplexity_low"], r["perplexity_high"]) == (pytest.approx(math.exp(low), rel=0.01), pytest.approx(math.exp(high), rel=0.01))
        inside = r["perplexity"] is not None and r["perplexity_low"] <= r["perplexity"] <= r["perplexity_high"]
        assert r["kept"] == (not r["base_failed"] and inside)


# op2: Witten-Bell models, score and threshold


def brute_witten_bell(texts):
    counts = defaultdict(Counter)
    for t in texts:
        for g in grams(t):
            for k in range(4):
                counts[g[k:-1]][g[-1]] += 1

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / 64
        seen = counts.get(g[:-1])
        if not seen:
            return lower
        return (seen[g[-1]] + len(seen) * lower) / (sum(seen.values()) + len(seen))

    return p


def test_url_query_by_brute_force(spark):
    found = registry.queries()["op2_url_filter"](spark, "/root/testdata/sf0.01").collect()
    address = {r["page_id"]: r["host"] + r["path"] for r in found}
    held = {i: zlib.crc32(a.encode()) % 5 == 0 for i, a in address.items()}
    ruled = {r["page_id"]: r["verdict"] for r in found if r["rule"] is not None}
    yes, no = (brute_witten_bell([address[i] for i, v in ruled.items() if v == c and not held[i]]) for c in ("allow", "block"))
    score = {}
    for i, a in address.items():
        gs = grams(a)
        score[i] = sum(math.log(yes(g)) - math.log(no(g)) for g in gs) / max(len(gs), 1)
    for r in found:
        assert r["score"] == pytest.approx(score[r["page_id"]], abs=2e-4)
    bins = {c: [math.floor(r["score"] * 100) for r in found if ruled.get(r["page_id"]) == c and held[r["page_id"]]] for c in ("allow", "block")}
    accuracy = lambda cut: sum(b >= cut for b in bins["allow"]) / len(bins["allow"]) + sum(b < cut for b in bins["block"]) / len(bins["block"])
    best = max(accuracy(c) for c in range(-2000, 2000))
    open_ = [(r["score"], r["verdict"]) for r in found if r["rule"] is None]
    allowed, blocked = [s for s, v in open_ if v == "allow"], [s for s, v in open_ if v == "block"]
    if allowed and blocked:
        assert max(blocked) < min(allowed)
        cuts = range(math.floor(max(blocked) * 100), math.ceil(min(allowed) * 100) + 1)
        assert any(accuracy(c) == pytest.approx(best) for c in cuts)


def test_odd_urls(spark):
    rows = [(1, "http://a.org/" + "x/" * 500_000), (2, "http://b.com/de/" + "y" * 1_000_000), (3, "http://" + "é" * 1000), (3, "http://" + "é" * 1000), (4, None), (5, "")]
    found = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert found[1]["verdict"] == "allow" and found[2]["verdict"] == "block" and len(found[2]["path"]) == 1_000_004
    assert found[4]["score"] == found[5]["score"] == 0


# op3


def test_keys_of_four_bytes_cover_any_six():
    keys = simhash._four_bytes()
    assert len(keys) == 12 and all(len(k) == 4 for k in keys)
    for six in combinations(range(8), 6):
        assert set().union(*[k for k in keys if set(k) <= set(six)]) == set(six)


def test_the_tally_drops_pairs_below_six(spark):
    a = 0x1122334455667788
    near, far = a ^ 0x0001000000000001, a ^ 0x0000010101010000  # two and four bytes differ
    pairs, crowded = simhash._met(spark.createDataFrame([(a,), (near,), (far,)], "fp long"), simhash._four_bytes(), 64)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {tuple(sorted((a, near)))}
    assert crowded.count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_near_dedup_keeps_rows_not_ids(spark, parts):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (2, a, "x"), (None, a, "x"), (None, "quite another text is here now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __ww_row string").repartition(parts)
    found = simhash.keep_one(df.drop("__ww_row").withColumn("fp", F.lit("mine"))).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted([(1, a), (1, b), (None, rows[5][1])], key=str)


def test_a_frequent_fingerprint_is_linked_like_others(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same few words here").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    want = {tuple(r) for r in simhash.near_duplicates(df).collect()}
    monkeypatch.setattr(simhash, "FREQUENT", 10**9)
    assert {tuple(r) for r in simhash.near_duplicates(df).collect()} == want
    monkeypatch.setattr(simhash, "FREQUENT", 0)
    assert {tuple(r) for r in simhash.near_duplicates(df).collect()} == want
    assert len(want) == 60 and len({c for _, _, c in want}) == 21


# op4


def test_machine_scores_by_brute_force(texts):
    rows = [np.array(toxicity.terms(t), np.uint32) for _, t, _ in texts]
    label = np.array([i % 3 == 0 for i in range(len(rows))], int)
    machine = toxicity.fit([np.r_[r, [7] * bool(k)].astype(np.uint32) for r, k in zip(rows, label, strict=True)], label, {0: 10, 1: 5})
    place = {h: i for i, h in enumerate(machine.known.tolist())}
    for row, got in list(zip(rows, machine.scores([r.tolist() for r in rows]), strict=True))[:40]:
        at = [place[h] for h in row.tolist() if h in place]
        z = machine.bias + sum(machine.weight[i] for i in at)
        z += sum(float(machine.vectors[i] @ machine.vectors[j]) for i, j in combinations(at, 2))
        assert got == pytest.approx(1 / (1 + math.exp(-min(max(z, -30), 30))), abs=1e-9)


def test_machine_learns_terms_that_only_matter_together():
    rng = np.random.default_rng(9)
    texts, label = [], []
    for _ in range(4000):
        a, b = int(rng.random() < 0.5), int(rng.random() < 0.5)
        texts.append(" ".join([f"w{int(k)}" for k in rng.integers(0, 300, 25)] + ["insult"] * a + ["group"] * b))
        label.append(a ^ b)
    machine = toxicity.fit([np.array(toxicity.terms(t)) for t in texts], np.array(label), {0: 2000, 1: 2000})
    scores = machine.scores([toxicity.terms(t) for t in ("insult w1", "group w2", "insult group w3", "w4")])
    assert min(scores[:2]) > 0.8 and max(scores[2:]) < 0.2


@pytest.mark.parametrize("rows, share, commoner", [(1400, 0.2, 0), (12000, 0.05, 1500)])
def test_machine_learns_a_pair_of_equal_margins(rows, share, commoner):
    """Insult and group are as common in both classes and meet in toxic rows only."""
    rng = np.random.default_rng(4)
    texts, label = [], []
    for i in range(rows):
        toxic, draw = i % 2, rng.random()
        words = [f"w{int(k)}" for k in rng.integers(0, 200, 10)]
        if commoner:
            words += [f"c{int(k)}" for k in rng.choice(commoner, 100, replace=False)]
        words += ["insult"] * (draw < share) + ["group"] * (draw < share if toxic else share <= draw < 2 * share)
        texts.append(" ".join(words))
        label.append(toxic)
    machine = toxicity.fit([np.array(toxicity.terms(t)) for t in texts], np.array(label), {0: rows // 2, 1: rows // 2})
    both, insult, group = machine.scores([toxicity.terms(t) for t in ("insult group", "insult", "group")])
    assert both > 0.8 and max(insult, group) < 0.5


def test_pair_screening_by_brute_force():
    rng = np.random.default_rng(8)
    label = np.array([i % 2 for i in range(60)])
    x = (rng.random((60, 40)) < 0.4).astype(np.uint8)
    z = np.zeros((40, 40))
    for i, j in combinations(range(40), 2):
        excess, variance = 0.0, 0.0
        for c, sign in ((1, 1), (0, -1)):
            side = x[label == c].astype(float)
            apart = side[:, i].mean() * side[:, j].mean()
            excess += sign * ((side[:, i] * side[:, j]).mean() - apart)
            variance += apart * (1 - apart) / len(side)
        z[i, j] = z[j, i] = abs(excess) / max(variance, 1e-9) ** 0.5
    for block in (3, 7, 512):
        toxicity.BLOCK_TERMS, toxicity.BLOCK_ROWS, before = block, block, (toxicity.BLOCK_TERMS, toxicity.BLOCK_ROWS)
        try:
            assert toxicity._paired(x, label) == pytest.approx(z.max(1), rel=1e-3)
        finally:
            toxicity.BLOCK_TERMS, toxicity.BLOCK_ROWS = before


def test_pair_bound_comes_from_the_sample_alone():
    """The order of the rows changes nothing, and a class that a fold lacks leaves chance as the bound."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12)) for _ in range(300)]
    label = np.array([int(5 in r) for r in rows])
    one = toxicity.fit(rows, label, {0: 200, 1: 100})
    turned = toxicity.fit(rows[::-1], label[::-1], {0: 200, 1: 100})
    assert one.known.tolist() == turned.known.tolist() and np.array_equal(one.weight, turned.weight)
    assert toxicity.fit([np.array([1, 2]), np.array([3])], np.array([1, 0]), {0: 1, 1: 1}).known.size == 0


def test_samples_are_bounded_by_bytes(spark):
    from wareweave.llm.sampling import labelled_sample

    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5]
    df = spark.createDataFrame([(i, "x" * (5000 if i % 7 == 0 else 100)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, toxic long")
    found = labelled_sample(df, labels, "toxic", 400, 8000)[0].collect()
    assert Counter(r["label"] for r in found) == {0: 40, 1: 40} and {len(r["text"]) for r in found} == {100}


# op5


@pytest.mark.parametrize("words", [3_000_000])
def test_bpe_of_a_very_long_text(spark, words):
    text = F.repeat(F.lit("lorem ipsum, dolor "), words // 3)
    df = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = bpe.digests(df).withColumn("want", F.sha2(text, 256)).first()
    _, enc = reference_encoding()
    assert got["decoded_sha256"] == got["want"]
    assert got["n_tokens"] == (words // 3 - 1) * (len(enc.encode_ordinary("lorem ipsum, dolor lorem ipsum, dolor ")) - len(enc.encode_ordinary("lorem ipsum, dolor "))) + len(enc.encode_ordinary("lorem ipsum, dolor "))


def test_bpe_around_white_space_and_long_pieces(monkeypatch):
    import random

    import public_tokenizers

    ranks, enc = reference_encoding()
    rng = random.Random(7)
    texts = ["a  b", "a   b", "a \n b", "\n \n b", "b  ", "  b", " ", "a\n  b", "x　 y", "'s  's", "a" * 3000, "ab" * 400]
    texts += ["".join(rng.choices("ab1! \n\t　\xa0\x1c'é", k=rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices("abcdefghij", k=k)) for k in (256, 257, 600, 2049)]
    want = [enc.encode_ordinary(t) for t in texts]
    for pattern in (public_tokenizers.PATTERN, f"(?:{public_tokenizers.PATTERN})"):  # cut into words, and not
        codec = bpe.Codec(ranks, pattern)
        packed = codec.encode(texts)
        assert [np.frombuffer(p, "<u4").tolist() for p in packed] == want
        assert codec.decode(packed) == [t.encode() for t in texts]
    monkeypatch.setattr(bpe, "STRETCH", 5)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    assert [np.frombuffer(p, "<u4").tolist() for p in codec.encode(texts)] == want
    monkeypatch.setattr(bpe, "IDS", 7)
    assert codec.decode(codec.encode(texts[:300])) == [t.encode() for t in texts[:300]]


def test_every_token_encodes_to_itself():
    import public_tokenizers

    ranks, _ = reference_encoding()
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    tokens = [t for t in ranks if len(t) <= bpe.SHORT]
    for i in range(0, len(tokens), 20_000):
        block = tokens[i : i + 20_000]
        assert codec.contract(block) == [ranks[t].to_bytes(4, "little") for t in block]

#: What one worker's process holds, without mapped files, after encoding texts of ever new words.
WORKER = """
import random, re
import public_tokenizers, pyarrow as pa
from wareweave.llm import bpe
from wareweave.llm.batches import SLICE_BYTES, slices, strings

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +([0-9]+)", open("/proc/self/smaps_rollup").read()))) >> 10

start, rng = held(), random.Random(3)
syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü", k=rng.randint(2, 4))) for _ in range(300)]
word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
texts = [" ".join(word() for _ in range(300)) for _ in range(4500)]
codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), public_tokenizers.PATTERN)
for part in slices(pa.record_batch({"text": texts}), "text", getattr(bpe, "SLICE_BYTES", SLICE_BYTES)):
    own = strings(part.column("text"))
    assert codec.decode(codec.encode(own)) == [t.encode() for t in own]
print(held() - start)
"""


def test_bpe_memory_of_a_worker():
    import subprocess
    import sys
    from pathlib import Path

    found = subprocess.run([sys.executable, "-c", WORKER], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert int(found.stdout) < 250, found.stdout


def test_bpe_caches_are_bounded_in_bytes():
    import public_tokenizers

    ranks, _ = reference_encoding()
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for k in range(40):  # few words, but long ones
        codec.encode([" ".join(f"{k:03}{i:03}" + "ab" * 20_000 for i in range(20))])
    held = [sum(len(t) + len(ids) for t, ids in kept.items()) for kept in (codec.pieces, codec.words)]
    assert max(held) < 60 << 20, held


# op8


@pytest.fixture(scope="module")
def licence_model(texts):
    lines = [line for _, t, _ in texts for line in t.split("\n") if line.strip()]
    return licenses.fit([x for x in lines if max(licenses.overlap(licenses.words(x), f)[0] for f in licenses.TEMPLATES) < 0.3][:1500])


def test_unknown_licence_wording_is_not_named(licence_model):
    assert 0.2 < licence_model.threshold < 0.9
    for text in ("You need a driving license and a general public transport card", "His poetic licence covers the public and the general reader of software."):
        assert not any(n[5] for n in licenses.notices(text, licence_model))


def test_wrapped_and_buried_notices(licence_model):
    mit = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:"""
    found = licenses.notices(mit, licence_model)
    assert {(n[2], n[5]) for n in found} == {("MIT", True)} and (found[0][0], found[-1][1]) == (2, 7)
    long = " ".join(["lorem"] * 2500) + " Licensed under the Apache License, Version 2.0. " + " ".join(["ipsum"] * 200_000)
    assert [(n[2], n[5]) for n in licenses.notices(long, licence_model)] == [("Apache-2.0", True)]
    both = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert [(n[0], n[2], n[5]) for n in licenses.notices(both, licence_model)] == [(0, "MIT", True), (1, "Apache-2.0", True)]


def test_licences_of_repeated_rows_and_clashing_columns(spark, licence_model):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "mine")] * 2 + [(2, None, "mine")], "doc_id long, text string, family string")
    assert [(r["doc_id"], r["family"]) for r in licenses.scan(df, licence_model).collect()] == [(1, "MIT")] * 2


# op9


def test_network_by_brute_force(texts):
    label = np.array([len(t) % 2 for _, t, _ in texts[:60]])
    raw = [t.encode() for _, t, _ in texts[:60]]
    net = quality_cnn.fit(raw, label, {0: 30, 1: 30})
    for t in [b"", b"short", *raw[:3]]:
        size = max(512, -(-len(t) // 4) * 4)
        data = t.ljust(size, b"\xff")
        firsts = [*range(0, size - 512, 448), size - 512]
        pooled = []
        for f in firsts:
            chunk = data[f : f + 512]
            responses = [np.concatenate([net.vectors[b] for b in chunk[i : i + 8]]) @ net.filters + net.offsets for i in range(0, 505, 4)]
            pooled.append(np.maximum(np.max(responses, 0), 0))
        z = np.r_[np.max(pooled, 0), np.mean(pooled, 0)] @ net.out + net.bias
        assert net.scores([t])[0] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


# op10


def test_shards_by_brute_force(spark, texts):
    rows = [(d, t) for d, t, _ in texts]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    keyed = sorted((signed(xxhash.xxh64_intdigest(t.encode(), 42)), signed(xxhash.xxh64_intdigest(struct.pack("<q", d), 42)), d, len(t.encode()) + 1) for d, t in rows)
    total, starts = sum(k[3] for k in keyed), []
    for b in range(1, 16):
        goal, seen = total * b / 16, 0
        for i, k in enumerate(keyed):
            if seen + k[3] >= goal:
                starts.append(i if goal - seen <= seen + k[3] - goal else i + 1)
                break
            seen += k[3]
    placed = [(sum(s <= i for s in starts), k[0] >> 58, k[1] >> 58, *k) for i, k in enumerate(keyed)]
    want, slots = {}, Counter()
    for shard, *k in sorted(placed):  # inside a shard by block, then by the keys
        want[k[4]] = (shard, slots[shard])
        slots[shard] += 1
    found = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), tolerance=0.0).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in found} == want
    check_shards(rows, found)


# long texts and rows without ids through every operator


def test_very_long_texts_and_missing_ids(spark):
    long = "word and another " * 120_000
    rows = [(1, long, "en", "a"), (None, long, "en", "a"), (None, "tiny", "en", None), (None, "tiny", "en", None), (2, "tiny", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality long, toxic long")
    assert perplexity.judge(df).count() == 5
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()} == {(1, 1), (None, 1), (None, 2), (2, 2)}
    assert simhash.keep_one(df).count() == 2
    assert toxicity.score(df, toxicity.train(df, labels)).count() == 5
    assert quality_cnn.score(df, quality_cnn.train(df, labels)).count() == 5
    assert {r["n_tokens"] for r in bpe.digests(df).collect() if r["doc_id"] == 1} == {360_001}
    assert sorted(r["group_size"] for r in exact_dedup.exact_dedup(df).collect()) == [2, 2, 3, 3, 3]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
