"""Quality rules with an n-gram perplexity band per language.

The model is an interpolated modified Kneser-Ney model of order five over code points,
words and the boundaries between them, and it grows with the corpus. Spark counts the
5-grams of all documents (each task tallies its share, the tallies are summed by code,
see points.py). Continuation counts, discounts, back-off and probabilities follow from
that table by grouping, windows and joins, order by order: a context has at most 4,096
followers and a suffix at most 4,096 predecessors, so no group grows with the corpus.
A 5-gram that one text alone holds, copies of it included, is left out of all counts and
backs off, as if it were scored by a model of all other texts: a text must not vouch for
itself.

Scoring needs one cost for each 5-gram, as every text was counted. The most frequent
5-grams, ``HOT`` at most, are broadcast as sorted hash arrays and looked up by binary
search where the texts are read. The others leave the task as (5-gram, times) of their
row and meet the rest of the table in a sort-merge join, so no cost is left out. Costs
are whole micronats: sums are exact in any order.

A document's perplexity is e to its mean cost in nats per word. Each language has a
lower and an upper bound: the median of the log perplexities of its documents that
pass the base rules, less or plus ``SPREADS`` robust standard deviations of that side
(from the lower or upper quartile), ``LEAST`` nats at least. The quartiles come from
exact counts over all documents in bins of 1/1000 nat, each distinct text hash counted
once so that a large group of copies does not set them.

Defined cases: null, empty and blank texts have no words, fail the base rules and have
a null perplexity; very long texts are counted and scored whole, in stretches, and their
windows of words are compared by 64-bit hashes, eight bytes a word; a null
language is a language of its own; repeated rows get the same result; a perplexity on
a bound is kept, and one above the largest double is infinite; a language whose documents all fail the base rules has no band and
rejects nothing further; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.llm.batches import add_columns
from wareweave.llm.common import checkpoint, table, whole_text
from wareweave.llm.points import BITS, ORDER, SYMBOLS, count_ngrams, stretches

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Half-width of a band in robust standard deviations, and in nats at least.
#: The tightest half-step that costs labelled good rows outside the held-out fold under 1 %.
SPREADS, LEAST = 4.5, 0.03
BINS_PER_NAT = 1000
#: 5-grams in the broadcast part of the model, 12 bytes each.
HOT = 1 << 21
MICRO = 1_000_000
SIGNS = re.compile(r"[#*$%&|<>]")
#: Bytes of a text whose words are split at once, and odd multipliers that make a window's hash of its words' hashes.
STRETCH_BYTES = 1 << 22
BLANK = re.compile(rb"[\x20\x09-\x0D]")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many n-grams have count 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    ratio = lambda a, b: b / a if a else 1 / 2
    raw = [k - (k + 1) * y * ratio(n[k - 1], n[k]) for k in (1, 2, 3)]
    return [min(max(d, 0.1 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw, strict=True)]


def _suffix(order: int) -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << BITS * order) - 1))


def _interpolate(level: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """One order's n-grams with p in place of n and suffix; n is 0 for those that only need a probability.

    Windows add counts, not discounts, so that no sum depends on its order.
    """
    n = level.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    cuts = _discounts(list(n))
    classes = [F.col("n") == 1, F.col("n") == 2, F.col("n") >= 3]
    context = Window.partitionBy(F.shiftright("code", BITS))
    level = level.select(
        "*", F.sum("n").over(context).alias("total"), *(F.sum(c.cast("long")).over(context).alias(f"c{k}") for k, c in enumerate(classes, 1))
    )
    lower = F.lit(1.0 / SYMBOLS) if shorter is None else F.col("lower")
    if shorter is not None:
        level = level.join(shorter.select(F.col("code").alias("suffix"), F.col("p").alias("lower")), "suffix")
    left = sum(d * F.col(f"c{k}") for k, d in enumerate(cuts, 1))
    cut = F.when(classes[0], cuts[0]).when(classes[1], cuts[1]).when(classes[2], cuts[2]).otherwise(0.0)
    own = (F.col("n") - cut + left * lower) / F.col("total")
    p = F.when(F.col("total") > 0, own).otherwise(lower)
    return level.withColumn("p", p).drop("n", "suffix", "lower", "total", "c1", "c2", "c3")


def kneser_ney(seen: DataFrame) -> DataFrame:
    """(code, n, cost): of every 5-gram, its count and its cost in micronats."""
    levels = [seen.select("code", F.col("n").alias("seen"), F.when(F.col("shared"), F.col("n")).otherwise(0).alias("n"))]
    for order in range(ORDER - 1, 0, -1):  # how many distinct symbols precede the suffix
        known = (F.col("n") > 0).cast("long")
        levels.insert(0, checkpoint(levels[0].groupBy(_suffix(order).alias("code")).agg(F.sum(known).alias("n"))))
    p = None
    for order, level in enumerate(levels, 1):
        p = _interpolate(level.withColumn("suffix", _suffix(order - 1)), p)
    return p.select("code", F.col("seen").alias("n"), F.round(-F.log("p") * MICRO).cast("int").alias("cost"))


def train(docs: DataFrame) -> DataFrame:
    """The model of all documents, a table (code, n, cost)."""
    return checkpoint(kneser_ney(checkpoint(count_ngrams(docs.select(whole_text().alias("text"))))))


def split(model: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The n-grams of the highest counts, ``most`` at most, and all others."""
    power = F.floor(F.log2("n") + 1e-9).cast("int")
    sizes = dict(model.groupBy(power.alias("power")).count().collect())  # 63 rows at most
    least = 63
    while least and sum(n for p, n in sizes.items() if p >= least - 1) <= most:
        least -= 1
    return model.filter(power >= least), model.filter(power < least)


def _word_hashes(text: str) -> np.ndarray:
    """The hash of each word; a stretch's words are held at once, cut where a blank is."""
    data, at, parts = text.encode("utf-8", "surrogatepass"), 0, [np.zeros(0, np.uint64)]
    while at < len(data):
        end = len(data)
        if at + STRETCH_BYTES < end and (blank := BLANK.search(data, at + STRETCH_BYTES)):
            end = blank.start()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, data[at:end].split()), np.uint64))
        at = end
    return np.concatenate(parts)


def _repeated(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = words[:-2] * MIX[0] + words[1:-1] * MIX[1] + words[2:]
    ordered = np.sort(windows)
    often = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(often):
        return 0
    often = np.unique(often)
    found = often[np.minimum(np.searchsorted(often, windows), len(often) - 1)] == windows
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(found)] |= found
    return int(covered.sum())


def word_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = _word_hashes(text)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = Counter(lines)
        dup = sum(n - 1 for line, n in seen.items() if n > 1 and line.encode("utf-8", "surrogatepass").split())
    symbols = sum(1 for _ in SIGNS.finditer(text))
    return len(words), chars, symbols, dup, _repeated(words) if len(words) > 3 else 0


def _rest(rows: np.ndarray, code: np.ndarray, n_rows: int) -> pa.Array:
    """A list of (code, times) for each row, from the row and code of each occurrence."""
    order = np.lexsort((code, rows))
    rows, code = rows[order], code[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])]) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, len(code)])
    offsets = np.searchsorted(rows[first], np.arange(n_rows + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(code[first].astype(np.int64)), pa.array(times.astype(np.int64))], names=["code", "times"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def score(docs: DataFrame, model: DataFrame, hot: int = HOT) -> DataFrame:
    """Add the rule columns and entropy, the mean cost in nats per word."""
    frequent, others = split(model, hot)
    found = frequent.select("code", "cost").toArrow()
    keys, costs = found.column("code").to_numpy(), found.column("cost").to_numpy()
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order].astype(np.uint64), costs[order].astype(np.int32)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__ww_cost")
    rest = T.ArrayType(T.StructType([T.StructField("code", T.LongType()), T.StructField("times", T.LongType())]))
    added = T.StructType([*(T.StructField(n, T.LongType()) for n in names), T.StructField("__ww_rest", rest)])

    def work(texts: list[str]) -> list[pa.Array]:
        rules = np.array([word_rules(t) for t in texts], np.int64).reshape(-1, 5)
        keys, costs = shared.value
        cost = np.zeros(len(texts), np.int64)
        rows, codes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
        for code, row in stretches(texts):
            wanted, which = np.unique(code, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
            each = np.where(known, costs[at], 0) if len(keys) else np.zeros(len(wanted))
            known = known[which]
            # below 2^53, so the weights' float sums are exact
            cost += np.bincount(row, each[which], len(texts)).astype(np.int64)
            rows.append(row[~known])
            codes.append(code[~known])
        return [
            *(pa.array(rules[:, i]) for i in range(5)),
            pa.array(cost),
            _rest(np.concatenate(rows), np.concatenate(codes), len(texts)),
        ]

    scored = add_columns(docs.withColumn("text", whole_text()), "text", added, work).drop("text")
    scored = checkpoint(scored.withColumn("__ww_row", F.monotonically_increasing_id()))
    left = scored.select("__ww_row", F.explode("__ww_rest").alias("pair")).select("__ww_row", "pair.code", "pair.times")
    left = left.join(others.select("code", "cost"), "code").groupBy("__ww_row").agg(F.sum(F.col("cost") * F.col("times")).alias("__ww_more"))
    cost = F.col("__ww_cost") + F.coalesce("__ww_more", F.lit(0))
    entropy = F.when(F.col("n_words") > 0, cost / F.col("n_words") / MICRO)
    scored = scored.drop("__ww_rest").join(left, "__ww_row", "left").withColumn("entropy", entropy)
    return scored.drop("__ww_row", "__ww_cost", "__ww_more")


def bands(scored: DataFrame) -> DataFrame:
    """(band_lang, low, high): bounds of the entropy of each language."""
    bins = (
        scored.filter(~F.col("base_failed"))
        .select("lang", "text_hash", F.round(F.col("entropy") * BINS_PER_NAT).cast("long").alias("bin"))
        .distinct()
        .groupBy("lang", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    share = F.sum("n").over(Window.partitionBy("lang").orderBy("bin")) / F.sum("n").over(Window.partitionBy("lang"))
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("bin"))) / BINS_PER_NAT
    quartiles = bins.withColumn("share", share).groupBy("lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    deviation = lambda a, b: F.greatest(F.lit(LEAST), (F.col(b) - F.col(a)) / 0.6745 * SPREADS)
    return quartiles.select(
        F.col("lang").alias("band_lang"),
        (F.col("q2") - deviation("q1", "q2")).alias("low"),
        (F.col("q2") + deviation("q2", "q3")).alias("high"),
    )


def judge(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, the rule columns, base_failed, perplexity, its bounds, and kept."""
    rows = docs.select("doc_id", "lang", whole_text().alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    scored = score(rows, train(docs), hot)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = checkpoint(scored.withColumn("base_failed", failed))
    # One row per language: checked, as a hint for a long list of languages would not hold.
    limits = checkpoint(bands(scored))
    limits = F.broadcast(limits) if limits.count() <= 10_000 else limits
    inside = F.col("entropy").between(F.col("low"), F.col("high"))
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.exp("entropy").alias("perplexity"),
        F.exp("low").alias("perplexity_low"),
        F.exp("high").alias("perplexity_high"),
    )


def perplexity_query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
