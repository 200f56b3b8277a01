"""URL filter: allow and block rules, and a character language-model ratio for the rest.

The URLs that a rule decides are the accepted and the rejected class. Spark counts the
symbol 4-grams of each class over all of them; from the counts come two Witten-Bell
smoothed variable-order Markov models (orders one to four, backing off to the longest
context seen), kept in sorted hash arrays of at most 2^24 entries. A URL's score is the
difference of its log likelihoods, divided by its symbols. A fifth of the ruled URLs,
by CRC, is kept out of the counts to calibrate the threshold: the score with the best
mean of both classes' accuracies on exact counts of their scores in bins of 1/100.

Defined cases: a null URL or one without "://" has an empty host and path, matches no
rule and has score 0; a class without ruled URLs leaves nothing to compare, and what
no rule decides is allowed; repeated rows get the same result; an empty table gives an
empty result; columns other than page_id and url are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wareweave.llm.batches import add_columns
from wareweave.llm.common import checkpoint, table
from wareweave.llm.ngrams import NgramTables, count_ngrams, gather, merge, suffix, text_sums
from wareweave.llm.symbols import ORDER, codes, symbols

#: (host and path prefix, verdict)
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
FOLDS = 5
BINS = 100
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parse(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))


def longest_rule(rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path; null if none."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the last to apply is the longest
        host, slash, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = fits & F.col("path").startswith(slash + path)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def witten_bell(code: np.ndarray, count: np.ndarray) -> NgramTables:
    """A variable-order model: each context leaves as much as it has distinct followers."""
    levels = [(code, count)]
    for order in range(ORDER - 1, 0, -1):
        longer, n = levels[0]
        levels.insert(0, merge([(suffix(longer, order), n)]))

    def smooth(n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds = np.diff(np.r_[first, len(n)])
        return n, kinds, np.add.reduceat(n, first) + kinds

    return NgramTables(levels, smooth)


def _scored(urls: DataFrame, accepted: NgramTables, rejected: NgramTables) -> DataFrame:
    """Add score: mean log likelihood ratio of the column ``address`` per symbol."""
    models = urls.sparkSession.sparkContext.broadcast((accepted, rejected))

    def work(texts: list[str]) -> list[pa.Array]:
        s, sizes = symbols(texts)
        code = codes(s, sizes)
        yes, no = (text_sums(m.score(code), sizes) for m in models.value)
        return [pa.array((yes - no) / np.maximum(sizes, 1))]

    return add_columns(urls, "address", T.StructType([T.StructField("score", T.DoubleType())]), work)


def calibrate(scored: DataFrame) -> float:
    """Threshold with the best balanced accuracy on the ruled URLs held out.

    Counts per class and bin come back: scores are bounded, so are the bins.
    """
    bins = (
        scored.filter("held_out AND verdict IS NOT NULL")
        .groupBy("verdict", F.floor(F.col("score") * BINS).cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    total = {v: sum(r["n"] for r in bins if r["verdict"] == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    allowed, blocked = total["allow"], 0
    cuts, last = [], None
    occupied = sorted({r["bin"] for r in bins})
    for b in [*occupied, occupied[-1] + 1]:
        # any cut in a gap decides the counted URLs alike; its middle is farthest from both
        middle = b / BINS if last is None else (last + 1 + b) / 2 / BINS
        cuts.append((allowed / total["allow"] + blocked / total["block"], -abs(middle), middle))
        allowed -= sum(r["n"] for r in bins if r["bin"] == b and r["verdict"] == "allow")
        blocked += sum(r["n"] for r in bins if r["bin"] == b and r["verdict"] == "block")
        last = b
    return max(cuts)[2]


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    urls = parse(pages).withColumn("hit", longest_rule(rules)).select("page_id", "host", "path", "hit.rule", "hit.verdict")
    urls = urls.withColumn("address", F.concat("host", "path"))
    urls = checkpoint(urls.withColumn("held_out", F.crc32(F.col("address").cast("binary")) % FOLDS == 0))
    train = urls.filter("NOT held_out")
    counted = [gather(count_ngrams(train.filter(F.col("verdict") == v).select("address"))) for v in ("allow", "block")]
    scored = checkpoint(_scored(urls, *(witten_bell(*c) for c in counted)).drop("address"))
    comparable = all(len(code) for code, _ in counted)
    judged = F.when(F.col("score") >= calibrate(scored), "allow").otherwise("block") if comparable else F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), "score")


def url_query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
