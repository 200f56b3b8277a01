"""Similarity and compatibility joins against plain Python, and how their work grows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareweave.operators import compat, hashes, similar, tiles, vectors
from wareweave.plans import registry
from wareweave.plans import similarity as plans_similarity

WORDS = [f"w{i}" for i in range(30)]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"t {kind}")


def names(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 9]))) for _ in range(n)]


LONG = [[" ".join(f"l{i + j}" for j in range(n)) for i in range(4)] for n in (90, 70)]
LEFT = [*names(120, 1), "", None, " \t", "W1 w1", *LONG[0]]
RIGHT = [*names(120, 2), "w1", "w1 w2", "w1", *LONG[1]]


def exact_jaccard(a, b, least):
    sets = lambda xs: {x: set((x or "").lower().split()) for x in xs}
    score = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    every = {(p, q): score(x, y) for p, x in sets(a).items() for q, y in sets(b).items()}
    return {k: v for k, v in every.items() if v >= least}


@pytest.mark.parametrize(("least", "most", "rows"), [(0.3, 3, 4096), (0.5, None, 7), (0.5, 1, 4096), (0.5, 2, 5), (0.8, 3, 7)])
def test_token_search_finds_exactly_what_all_pairs_find(spark, least, most, rows):
    got = similar.jaccard_pairs(similar.token_sets(column(spark, LEFT), "t"), similar.token_sets(column(spark, RIGHT), "t"), least, rows, most).collect()
    want = exact_jaccard(LEFT, RIGHT, least)
    assert len(got) == len(want) and {(r["a"], r["b"]): pytest.approx(r["similarity"]) for r in got} == want
    assert any(len(a.split()) > similar.LONG for a, _ in want) or least > 0.7


def test_the_best_titles_of_a_name(spark):
    got = similar.name_search(column(spark, LEFT), "t", column(spark, RIGHT), "t", 2, 0.4).collect()
    want = []
    for name in {n for n in LEFT if n}:
        found = sorted(((-v, b) for (a, b), v in exact_jaccard([name], RIGHT, 0.4).items()))[:2]
        want += [(name, b, -v, rank) for rank, (v, b) in enumerate(found, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_of_empty_tables(spark):
    one, none = column(spark, ["a b"]), column(spark, [None, ""])
    assert similar.name_search(one, "t", none, "t").count() == similar.name_search(none, "t", one, "t").count() == 0


def test_pairs_of_tokens_meet_far_fewer_names(spark):
    """The smaller work is chosen: a common token alone would bring all names together."""
    rng = random.Random(3)
    rows = sorted({"common " + " ".join(f"{c}{rng.randrange(8)}" for c in "abcde") for _ in range(1500)})
    side = similar.ranked([similar.token_sets(column(spark, rows), "t")])[0]
    need, reach = lambda m: F.ceil(m * 0.6 - 1e-9).cast("int"), lambda s: F.floor(s / 0.6 + 1e-9).cast("int")
    met = lambda c: similar.postings(side, need, reach, c).groupBy("kind", "key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    chosen = similar.cheapest(side, side, need, reach)
    assert chosen > 1 and met(chosen) < met(1) / 3


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        new = [0]
        for j, d in enumerate(y):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9, 1.0])
def test_edit_join_finds_exactly_what_all_pairs_find(spark, least):
    rng = random.Random(5)
    a = ["".join(rng.choice("abcde ") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 18, 25]))) for _ in range(50)]

    def changed(w):
        w = list(w)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            i = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w.insert(i, rng.choice("abcxyz"))
            elif w:
                del w[min(i, len(w) - 1)]
        return "".join(w)

    b = [changed(w) for w in a for _ in range(2)] + ["", "가격표", "x" * 118 + "yy"]
    a += ["", None, "가격 표", "x" * 120]
    ratio = lambda x, y: 2 * lcs(x, y) / (len(x) + len(y)) if x or y else 1.0
    want = {(x, y): v for x in set(a) if x is not None for y in set(b) if (v := ratio(x, y)) >= least - 1e-12}
    got = similar.edit_pairs(column(spark, a), "t", column(spark, b), "t", least).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): pytest.approx(r["ratio"]) for r in got} == want


def test_only_survivors_are_compared(spark):
    """The count filter leaves a small share of the pairs to the longest common subsequence."""
    rng = random.Random(6)
    rows = ["".join(rng.choice("abcdefghijklmnop") for _ in range(24)) for _ in range(300)]
    side = similar.grams(column(spark, rows), "t", 2)
    need = lambda m: F.greatest(F.ceil(m * (3 * 0.85 - 2) / 1.15 - 1).cast("int"), F.lit(1))
    met = similar.overlapping(side, side, need, lambda s: F.floor(s * 1.15 / 0.85).cast("int"), None)
    assert met.count() < 300 * 300 / 10


# tiles


def test_tiles_bring_every_pair_together_once(spark):
    a = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    b = spark.range(37).select((F.col("id") % 3).alias("k"), F.col("id").alias("y"))
    got = tiles.tiled_join(a, b, ["k"], [F.col("x")], [F.col("y")], 4).select("x", "y").collect()
    assert sorted(map(tuple, got)) == sorted((x, y) for x in range(50) for y in range(37) if x % 2 == y % 3)
    one = tiles.self_tiled(a, ["k"], [F.col("x")], 4)
    left, right = (one.select("k", "tile", "cross", "second", F.col("x").alias(c)) for c in "pq")
    met = left.withColumnRenamed("second", "s").join(right, ["k", "tile", "cross"]).filter("(cross AND NOT s AND second) OR (NOT cross AND p < q)")
    pairs = [tuple(sorted((r["p"], r["q"]))) for r in met.collect()]
    assert sorted(pairs) == sorted((p, q) for p in range(50) for q in range(p + 1, 50) if p % 2 == q % 2)
    assert one.groupBy("k", "tile").count().agg(F.max("count")).first()[0] <= 24


# fused hashes


def fused(spark, ids, rows):
    signed = lambda x: int(x) - (1 << 64) if x >> 63 else int(x)
    df = spark.createDataFrame([(int(i), *[signed(int(x)) for x in r]) for i, r in zip(ids, rows, strict=True)], "i long, a long, b long, c long")
    return sorted(map(tuple, hashes.fused_near(df, "i", "a", "b", "c").collect()))


def exact_fused(ids, rows):
    first = {}
    for i, t in zip(ids, map(tuple, rows.tolist()), strict=True):
        first[t] = min(first.get(t, i), i)
    triples = np.array(list(first), dtype=np.uint64)
    cost = (np.bitwise_count(triples[:, None] ^ triples[None]).astype(int) * np.array([2, 5, 3])).sum(2)
    near = (1 - cost / 640) > 0.95
    np.fill_diagonal(near, False)
    root, changed = list(first.values()), True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    of = {t: (i, int(n), r) for (t, i), n, r in zip(first.items(), near.sum(1), root, strict=True)}
    return sorted((i, *of[t]) for i, t in zip(ids, map(tuple, rows.tolist()), strict=True))


@pytest.mark.parametrize("tile", [2048, 3])
def test_fused_hashes_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(hashes, "TILE_ROWS", tile)
    rng = np.random.default_rng(1)
    rows = []
    for base in rng.integers(0, 2**64, size=(40, 3), dtype=np.uint64):
        rows.append(base)
        for _ in range(4):
            copy = base.copy()
            for k, most in enumerate((16, 7, 11)):
                for bit in rng.choice(64, rng.integers(0, most // 2 + 1), replace=False):
                    copy[k] ^= np.uint64(1) << np.uint64(bit)
            rows.append(copy)
    rows = np.array([*rows, rows[0], rows[0]], dtype=np.uint64)
    ids = rng.permutation(len(rows)).tolist()
    want = exact_fused(ids, rows)
    assert sum(r[2] for r in want) > 50 and fused(spark, ids, rows) == want


def test_every_near_pair_shares_a_key():
    """A pair within the budget has its second or third hash at most three bits apart."""
    worst = [(a, b, c) for a in range(17) for b in range(8) for c in range(12) if 2 * a + 5 * b + 3 * c <= hashes.MOST]
    assert all(min(b, c) <= hashes.APART for _, b, c in worst)
    assert 1 - (hashes.MOST + 1) / 640 <= 0.95 < 1 - hashes.MOST / 640


def test_rows_stay_linear_where_all_hashes_are_alike(spark):
    rows = np.array([[7, i, 7] for i in range(1024)], dtype=np.uint64)  # 54 bits of the second are shared
    got = fused(spark, range(1024), rows)
    assert len(got) == 1024 and {r[3] for r in got} == {0} and got == exact_fused(range(1024), rows)
    df = spark.createDataFrame([(int(i), 7, int(r[1]), 7) for i, r in enumerate(rows)], "id long, h1 long, h2 long, h3 long")
    assert hashes.linked(df).count() <= 20 * 1024


def test_images_without_hashes(spark):
    df = spark.createDataFrame([(1, 5, 5, 5), (2, None, 5, 5), (None, 5, 5, 5), (3, 5, 5, 5)], "i long, a long, b long, c long")
    assert sorted(map(tuple, hashes.fused_near(df, "i", "a", "b", "c").collect())) == [(1, 1, 0, 1), (3, 1, 0, 1)]
    assert hashes.fused_near(df.filter("a > 9"), "i", "a", "b", "c").count() == 0


# vectors


def test_index_finds_most_of_the_nearest(spark):
    sf = "/root/testdata/sf0.1"
    found, exact = ({(r["query_id"], r["vec_id"]) for r in registry.queries()[n](spark, sf).collect()} for n in ("embedding_index", "embedding_topk"))
    assert len(found & exact) >= 0.9 * len(exact)


def test_index_searches_few_lists_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 4
    data = [(i, (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(3000)]
    data += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, data[0][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 50 = 0")
    units = vectors.unit(df, 16)
    assert units.count() == 3001
    exact, found = ({(r["query_id"], r["vec_id"]) for r in f(df, queries, 5, 16).collect()} for f in (vectors.cosine_topk, vectors.index_topk))
    assert len(found & exact) >= 0.9 * len(exact) and (0, 9004) in found
    centroids = vectors.fit_centroids(units)
    assert vectors.lists_needed(units, vectors.unit(queries, 16), centroids, 5) <= len(centroids) / 4


def test_exact_search_by_numpy(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 30)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)
    values = np.random.default_rng(5).normal(size=(100, 8))
    values[50] = values[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    queries = df.filter("vec_id % 10 = 0")
    units = values / np.linalg.norm(values, axis=1, keepdims=True)
    cosine = units @ units.T
    got = {(r["query_id"], r["vec_id"]): r["cosine"] for r in vectors.cosine_above(df, queries, 0.3, 8).collect()}
    want = {(q, v): cosine[q, v] for q in range(0, 100, 10) for v in range(100) if q != v and cosine[q, v] >= 0.3}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# prices and categories


@pytest.mark.parametrize("rows", [4096, 3])
def test_price_band_alone(spark, rows):
    rng = random.Random(7)
    a = [(i, rng.choice([None, 0.0, -1.0, 100.0, rng.uniform(50, 200)])) for i in range(60)]
    b = [(i, rng.choice([None, 0.0, 70.0, 142.857, rng.uniform(50, 200)])) for i in range(50)]
    left, right = spark.createDataFrame(a, "i int, p double"), spark.createDataFrame(b, "j int, q double")
    got = sorted((tuple(r) for r in compat.band_pairs(left, right, "p", "q", 0.3, rows).collect()), key=str)
    real = lambda x: x is not None and x > 0
    want = [(i, p, j, q) for i, p in a for j, q in b if real(p) and real(q) and abs(p - q) / max(p, q) <= 0.3]
    want += [(i, p, None, None) for i, p in a if not real(p)] + [(None, None, j, q) for j, q in b if not real(q)]
    assert got == sorted(want, key=str)


GROUPS = {"g": ("a", "b", "c"), "h": ("b", "c"), "own": ("x",)}


@pytest.mark.parametrize("rows", [4096, 3])
def test_compatible_categories(spark, rows):
    rng = random.Random(8)
    pick = lambda: rng.choice([None, "", " ", "a", "B ", "c", "d", "g", "x"])
    a, b = [(i, i % 3, pick()) for i in range(40)], [(i, i % 3, pick()) for i in range(30)]
    left, right = spark.createDataFrame(a, "i int, k int, c string"), spark.createDataFrame(b, "j int, k int, d string")
    norm = lambda c: (c or "").strip().lower()
    fits = lambda x, y: not x or not y or x == y or any(x in m and y in m for m in GROUPS.values())
    want = sorted((i, j) for i, k, c in a for j, m, d in b if k == m and fits(norm(c), norm(d)))
    got = compat.compatible_pairs(left, right, "c", "d", GROUPS, ["k"], rows)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    classes = {(r["category_a"], r["category_b"]): (r["n_a"], r["n_b"]) for r in compat.category_classes(left, right, "c", "d", GROUPS).collect()}
    count = lambda xs, v: sum(norm(x[2]) == v for x in xs)
    assert classes == {(x, y): (count(a, x), count(b, y)) for x in {norm(r[2]) for r in a} for y in {norm(r[2]) for r in b} if fits(x, y)}


@pytest.mark.parametrize("rows", [4096, 3])
def test_classes_give_all_compatible_pairs(spark, rows):
    """Members and linked classes, put together, are the pairs; the rows do not grow with them."""
    rng = random.Random(9)
    pick = lambda: rng.choice([None, "", " ", "a", "B ", "c", "d", "x"])
    a, b = [(i, rng.choice([0, 1, None]), pick()) for i in range(90)], [(i, rng.choice([0, 1, None]), pick()) for i in range(80)]
    left, right = spark.createDataFrame(a, "i int, k int, c string"), spark.createDataFrame(b, "j int, k int, d string")
    norm = lambda c: (c or "").strip().lower()
    fits = lambda x, y: not x or not y or x == y or any(x in m and y in m for m in GROUPS.values())
    want = sorted((i, j) for i, k, c in a for j, m, d in b if k is not None and k == m and fits(norm(c), norm(d)))
    got = compat.compatible_members(left, right, "i", "j", "c", "d", GROUPS, ["k"], rows).collect()
    of = {kind: [r for r in got if r["kind"] == kind] for kind in ("left", "right", "pair")}
    assert [sorted((r["id"], r["category"] or "") for r in of[s]) for s in ("left", "right")] == [sorted((r[0], r[2] or "") for r in rows_) for rows_ in (a, b)]
    members = {s: {c: [r["id"] for r in of[s] if r["class_id"] == c] for c in {r["class_id"] for r in of[s]}} for s in ("left", "right")}
    assert all(min(ids) == c for s in members.values() for c, ids in s.items())
    assert sorted((i, j) for p in of["pair"] for i in members["left"][p["id"]] for j in members["right"][p["class_id"]]) == want
    assert all(p["links"] == len(members["left"][p["id"]]) * len(members["right"][p["class_id"]]) for p in of["pair"])
    for s, at in (("left", 0), ("right", 1)):
        assert {r["id"]: r["links"] for r in of[s]} == {r["id"]: sum(p[at] == r["id"] for p in want) for r in of[s]}


def test_exploded_sides_are_not_broadcast(spark):
    """A side's estimate does not see what it explodes into, so it is merged however small it looks."""
    side = spark.range(100).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(50))).alias("k"))
    other = spark.range(100).select(F.col("id").alias("y"), (F.col("id") % 50).alias("k"))
    text = tiles.tiled_join(side, other, ["k"], [F.col("x")], [F.col("y")])._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line and "__ww_i" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("name", ["price_band_join", "match_path", "match_path_by_edits", "matched_second_stage", "hash_neardup", "tfidf_pair_cosine"])
def test_product_tables_are_not_broadcast(spark, name):
    """Sides that grow with the products are merged; only the suppliers, the fixed categories and written short tables may be broadcast."""
    text = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for line in text.splitlines():
        if "BroadcastHashJoin" in line:
            assert not {"product_id", "p_partkey", "l_partkey", "h", "bits", "__ww_b"} & {c.split("#")[0].strip("[") for c in line.split("BroadcastHashJoin")[1].replace(",", " ").split()}
    assert "SortMergeJoin" in text or name == "match_path"


def test_names_are_scored_once_for_all_products(spark):
    """tfidf_pair_cosine scores distinct pairs of names before a checkpoint: no scoring is left in the plan of the products."""
    text = registry.queries()["tfidf_pair_cosine"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in text and "regexp_extract_all" not in text


@pytest.mark.parametrize(("bits", "stripe", "chunk"), [(128, 64, 8192), (20, 3, 7)])
def test_edit_pairs_in_blocks_lose_nothing(spark, monkeypatch, bits, stripe, chunk):
    """Blocks, stripes and characters without a bit: all pairs, as many as brute force finds, texts above a machine word among them."""
    monkeypatch.setattr(similar, "BITS", bits)
    monkeypatch.setattr(similar, "STRIPE", stripe)
    monkeypatch.setattr(similar, "CHUNK", chunk)
    rng = random.Random(11)
    a = [" ".join(rng.choice(["red", "ring", "Brand#7", "bolt", "가격", "x" * 30]) for _ in range(rng.choice([1, 2, 4, 6]))) for _ in range(60)]
    b = [w[:-1] + "z" for w in a] + [w + " 1" for w in a] + a[:5]
    ratio = lambda x, y: 2 * lcs(x, y) / (len(x) + len(y))
    want = {(x, y): v for x in set(a) for y in set(b) if (v := ratio(x, y)) >= 0.8}
    got = similar.edit_pairs(column(spark, a), "t", column(spark, b), "t", 0.8, 16).collect()
    assert max(map(len, a)) > 64 and len(got) == len(want)
    assert {(r["a"], r["b"]): pytest.approx(r["ratio"]) for r in got} == want


def test_search_takes_every_fiftieth_product(spark):
    sf = "/root/testdata/sf0.001"
    names = {r["full_name"] for r in plans_similarity._messy(spark, sf).filter("product_id % 50 = 0").select("full_name").collect()}
    assert {r["name"] for r in registry.queries()["name_search"](spark, sf).select("name").collect()} <= names


def test_category_join_gives_every_pair(spark):
    """A row for each two products that go together, not one for their classes."""
    sf = "/root/testdata/sf0.001"
    left, right = (side.collect() for side in plans_similarity._sides(spark, sf))
    norm = lambda c: (c or "").strip().lower()
    fits = lambda x, y: not x or not y or x == y or any(x in m and y in m for m in plans_similarity._GROUPS.values())
    want = [
        (a["product_id"], b["other_id"], a["category"], b["other_category"])
        for a in left for b in right if (a["brand"], a["size"]) == (b["brand"], b["size"]) and fits(norm(a["category"]), norm(b["other_category"]))
    ]
    got = registry.queries()["category_join"](spark, sf)
    assert got.columns == ["product_id", "other_id", "category", "other_category"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > len(left) / 2


def test_name_search_takes_every_name(spark):
    """The name of every product is a query, against all titles."""
    sf = "/root/testdata/sf0.001"
    rows = plans_similarity._messy(spark, sf).select("full_name", "offer_title").collect()
    queries, titles = sorted({r["full_name"] for r in rows}), sorted({r["offer_title"] for r in rows})
    want = []
    for name in queries:
        found = sorted((-v, b) for (a, b), v in exact_jaccard([name], titles, 0.5).items())[:5]
        want += [(name, b, pytest.approx(-v), rank) for rank, (v, b) in enumerate(found, 1)]
    got = sorted(map(tuple, registry.queries()["name_search"](spark, sf).collect()), key=lambda r: (r[0], r[3]))
    assert got == want and len({r[0] for r in want}) > 0.9 * len(queries) > 100


@pytest.mark.parametrize(("least", "rows", "many"), [(0.3, 4096, 35), (0.5, 7, 35), (0.5, 4096, 1), (0.8, 5, 500)])
def test_keys_of_both_sizes_find_exactly_what_all_pairs_find(spark, monkeypatch, least, rows, many):
    monkeypatch.setattr(similar, "MANY", many)
    sides = [similar.token_sets(column(spark, x), "t") for x in (LEFT, RIGHT)]
    got = similar.jaccard_pairs(*sides, least, rows, similar.BY_SIZE).collect()
    want = exact_jaccard(LEFT, RIGHT, least)
    assert len(got) == len(want) and {(r["a"], r["b"]): pytest.approx(r["similarity"]) for r in got} == want
    none = similar.token_sets(column(spark, [None, ""]), "t")
    assert similar.jaccard_pairs(sides[0], none, least, rows, similar.BY_SIZE).count() == similar.jaccard_pairs(none, sides[1], least, rows, similar.BY_SIZE).count() == 0


def test_search_meets_few_pairs_that_are_none(spark):
    """Names of few different words in many combinations: the keys of both sizes are chosen, and what meets grows with the result."""
    rng = random.Random(4)
    make = lambda k: sorted({" ".join(f"{c}{rng.randrange(9)}" for c in "abcdef"[:k]) for _ in range(1500)})
    a, b = make(5), make(6)
    sides = similar.ranked([similar.token_sets(column(spark, x), "t") for x in (a, b)])
    need, reach, both = lambda m: F.ceil(m * 0.5).cast("int"), lambda s: s * 2, lambda n, m: -(-(n + m) // 3)
    sized = similar._by_size(*sides, both)
    met = lambda x, y: x.groupBy("kind", "key").count().join(y.groupBy("kind", "key").agg(F.count("text").alias("n")), ["kind", "key"]).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert similar.cheapest(*sides, need, reach, sized) == similar.BY_SIZE
    assert met(*sized) < met(*[similar.postings(s, need, reach, 3) for s in sides]) / 5
    want = exact_jaccard(a, b, 0.5)
    assert met(*sized) < 1.5 * len(want)
    got = similar.jaccard_pairs(*[similar.token_sets(column(spark, x), "t") for x in (a, b)], 0.5).collect()
    assert {(r["a"], r["b"]) for r in got} == set(want) and len(got) == len(want)


@pytest.mark.parametrize(("rows", "on"), [(4096, ["k"]), (3, ["k"]), (5, [])])
def test_rows_of_linked_categories_are_all_compatible_pairs(spark, monkeypatch, rows, on):
    monkeypatch.setattr(compat, "TASK_PAIRS", 100)
    rng = random.Random(10)
    pick = lambda: rng.choice([None, "", " ", "a", "B ", "c", "d", "g", "x"])
    a, b = [(i, rng.choice([0, 1, None]), pick()) for i in range(60)], [(i, rng.choice([0, 1, None]), pick()) for i in range(50)]
    left, right = spark.createDataFrame(a, "i int, k int, c string"), spark.createDataFrame(b, "j int, k int, d string")
    if not on:
        left, right = left.drop("k"), right.drop("k")
    norm = lambda c: (c or "").strip().lower()
    fits = lambda x, y: not x or not y or x == y or any(x in m and y in m for m in GROUPS.values())
    want = [(i, j, c, d) for i, k, c in a for j, m, d in b if (not on or k is not None and k == m) and fits(norm(c), norm(d))]
    got = compat.compatible_rows(left, right, "c", "d", GROUPS, on, rows).select("i", "j", "c", "d").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert compat.compatible_rows(left.limit(0), right, "c", "d", GROUPS, on, rows).count() == 0
