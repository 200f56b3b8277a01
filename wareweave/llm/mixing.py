"""Mixing sources to target weights by systematic sampling, DataFrame functions only.

Each source's target share is its weight's share of all words, capped at ``CAP``
times the source, the excess reshared. Every document of a source then expects
target/source_size copies; the prefix sum of these expected copies along the
source's order, plus one random offset of the source, crosses an integer once for
each copy that is emitted. The order goes by size class (integer part of the square
root), then by an MD5 of doc_id and text, so a systematic sample takes every size class in
proportion. A source's large documents (above ``LARGE_TARGET`` of its target and
``LARGE_SOURCE`` of its words, so under 1/``LARGE_SOURCE`` rows a source) come
first in the prefix sum, the largest first, and each document expects what is still open:
(target - words taken so far) / (words not yet passed) copies, ``CAP`` at most. A large
document that would exceed the target expects fewer whole copies, if the rest can make up for
it, and more if the rest could not. The other documents of a source share one such ratio. So a
source misses its target by about its largest small document, not by its largest one.
The offset is one pseudo-random draw, seeded by the source's name, so
reruns agree.

No source is gathered in one task: a source is cut into blocks by size class and
MD5 prefix (256 of each class: a source of 10^10 documents in twenty classes has two
million rows a block), blocks are numbered inside and get their start from the block
counts. The text is part of the MD5, so rows without doc_id spread like all others.

Defined cases: a null text has size 0 and may be emitted, taking nothing; a very long
text counts all its words and is a class of its own size; a null source is a source of
its own, sorted last; a null doc_id counts as the text "null" in the order; ties are
rows of the same doc_id and text, which are alike; repeated rows are sampled as rows; a source without words has
target 0; an empty table gives an empty result; input columns named like an output
column are replaced, all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareweave.llm.common import WORD, checkpoint, shield, table, unshield, whole_text, without

WEIGHTS = (5, 2, 1)
#: A source is taken this many times over at most.
CAP = 3
#: Shares of its source's target and of its source's words from which a document is large.
LARGE_TARGET, LARGE_SOURCE = 0.01, 0.002
#: Hexadecimal digits of the MD5 that cut a size class into blocks.
BLOCK_DIGITS = 2
#: Sources up to which their table is broadcast; beyond it the join is left to AQE.
BROADCAST_SOURCES = 20_000
ADDED = ("size", "source_size", "target", "copies", "taken")
#: Other names that a mix uses on the way.
WORKING = ("sid", "ratio", "offset", "start", "before", "rest_ratio", "least", "walked")
BLOCK = ("__ww_class", "__ww_block")


def sized(docs: DataFrame) -> DataFrame:
    """Add the word count and the columns of the sampling order."""
    text = whole_text()
    return (
        without(docs, *ADDED, *WORKING)
        .withColumn("size", F.regexp_count(text, F.lit(WORD)).cast("long"))
        .withColumn("__ww_class", F.floor(F.sqrt("size")).cast("int"))
        .withColumn("__ww_md5", F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary"))).cast("binary")))
        .withColumn("__ww_block", F.substring("__ww_md5", 1, BLOCK_DIGITS))
    )


def _numbered_sources(rows: DataFrame) -> DataFrame:
    """source, source_size, sid: sources in code point order, null last, from 0.

    The order comes from a range partitioning and the counts of its partitions, so
    that a long list of sources does not meet in one task.
    """
    parts = checkpoint(
        rows.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .repartitionByRange(F.asc_nulls_last("source"))
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return parts.withColumn("i", inside).join(starts, "part").select(
        "source", "source_size", (F.col("start") + F.col("i") - 1).alias("sid")
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, sid, source_size, weight, target."""
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights)).cast("int"))
    sources = checkpoint(_numbered_sources(rows).withColumn("weight", weight.cast("long")))
    most = F.col("source_size") * cap
    rest, free, capped = None, None, F.lit(False)
    while True:  # only sums come back; each round caps one more source at least
        now = sources.filter(~capped).agg(F.sum("weight"), F.count(F.lit(1))).first()
        used = sources.agg(F.sum("source_size"), F.sum(F.when(capped, most))).first()
        if not now[1] or now[1] == free:
            break
        rest, free, total = (used[0] or 0) - (used[1] or 0), now[1], now[0]
        capped = most.cast("double") < F.lit(float(rest)) * F.col("weight") / F.lit(total)
    if rest is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn(
        "target", F.least(most.cast("double"), F.lit(float(rest)) * F.col("weight") / F.lit(total))
    )


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the source's columns; the large rows of a source are a block of their own, the first."""
    known = rows.withColumnRenamed("source", "__ww_source")
    known = known.join(_small(sources), F.col("__ww_source").eqNullSafe(F.col("source"))).drop("__ww_source")
    large = F.col("size") > F.col("least")
    return known.withColumn("__ww_class", F.when(large, -1).otherwise(F.col("__ww_class"))).withColumn(
        "__ww_block", F.when(large, "").otherwise(F.col("__ww_block"))
    )


def _inside():
    """A row's number in its block; the largest of the large rows come first."""
    size = F.when(F.col("__ww_class") < 0, F.col("size")).otherwise(0)
    return F.row_number().over(Window.partitionBy("sid", *BLOCK).orderBy(size.desc(), "__ww_md5", "doc_id"))


def _copies(at, ratio, offset):
    """Integers that the prefix sum of expected copies crosses at this position."""
    return (F.floor(offset + ratio * at) - F.floor(offset + ratio * (at - 1))).cast("long")


def _walk(sizes, cap: int):
    """Copies of a source's large rows, the largest first, each by what is still open; and the state after them."""

    def step(state, size):
        size = size.cast("double")
        opened = F.col("target") - state["got"]
        after = F.col("source_size") - state["seen"] - size
        even = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), opened / (after + size)))
        fewest = F.floor((opened - cap * after) / size + 0.5).cast("double")
        fewest = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), fewest))
        most = F.floor(opened / size).cast("double")
        expected = F.greatest(fewest, F.least(even, most))
        prefix = state["prefix"] + expected
        copies = (F.floor(prefix) - F.floor(state["prefix"])).cast("long")
        return F.struct(
            prefix.alias("prefix"),
            (state["got"] + copies * size).alias("got"),
            (state["seen"] + size).alias("seen"),
            F.concat(state["copies"], F.array(copies)).alias("copies"),
        )

    none = F.array().cast("array<bigint>").alias("copies")
    start = F.struct(F.col("offset").alias("prefix"), F.lit(0.0).alias("got"), F.lit(0.0).alias("seen"), none)
    return F.aggregate(F.sort_array(sizes, asc=False), start, step)


def plan_mix(rows: DataFrame, weights=WEIGHTS, cap=CAP) -> tuple[DataFrame, DataFrame]:
    """Source table with targets, copies of the large rows and the ratio of the others, and the start of every block."""
    sources = source_targets(rows, weights, cap)
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    least = F.greatest(F.col("target") * LARGE_TARGET, F.col("source_size") * LARGE_SOURCE)
    sources = checkpoint(
        sources.select("source", "sid", "source_size", "target", draw.alias("offset"), least.alias("least"))
    )
    large = _with_source(rows, sources).filter("__ww_class < 0")  # under 1 / LARGE_SOURCE rows a source
    large = large.groupBy("sid").agg(F.collect_list("size").alias("sizes"))
    sizes = F.coalesce(F.col("sizes"), F.array().cast("array<bigint>"))
    walked = sources.join(large, "sid", "left").withColumn("walked", _walk(sizes, cap)).drop("sizes", "offset")
    left = F.col("source_size") - F.col("walked.seen")
    rest = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), (F.col("target") - F.col("walked.got")) / left))
    sources = checkpoint(
        walked.withColumn("rest_ratio", F.when(left > 0, rest).otherwise(0.0))
        .withColumn("before", F.col("walked.prefix"))
        .withColumn("walked", F.col("walked.copies"))
    )
    counts = _with_source(rows, sources.select("source", "sid", "least")).groupBy("sid", *BLOCK).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counted = F.sum(F.when(F.col("__ww_class") >= 0, F.col("n"))).over(before)
    starts = checkpoint(counts.select("sid", *BLOCK, F.coalesce(counted, F.lit(0)).alias("start")))
    return sources, starts


def mix(rows: DataFrame, sources: DataFrame, starts: DataFrame) -> DataFrame:
    """All rows with source_size, target, copies (emissions) and taken (words)."""
    known = _with_source(rows, sources).withColumn("__ww_i", _inside()).join(starts, ["sid", *BLOCK])
    small = _copies(F.col("start") + F.col("__ww_i"), F.col("rest_ratio"), F.col("before"))
    large = F.get("walked", F.col("__ww_i") - 1)
    known = known.withColumn("copies", F.when(F.col("__ww_class") < 0, large).otherwise(small))
    return known.withColumn("taken", F.col("copies") * F.col("size")).drop(
        "sid", "walked", "before", "rest_ratio", "least", "start", "__ww_i", *BLOCK, "__ww_md5"
    )


def narrow(rows: DataFrame) -> DataFrame:
    return checkpoint(rows.select("doc_id", "source", "size", *BLOCK, "__ww_md5"))


def emit(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: docs' columns, each row as often as the mix takes it."""
    rows = sized(shield(docs, *ADDED, *WORKING))
    sources, starts = plan_mix(narrow(rows))
    mixed = mix(rows, sources, starts).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return unshield(mixed.withColumn("__ww_copy", times), docs.columns)


def mix_query(spark, sf_dir: str) -> DataFrame:
    rows = narrow(sized(table(spark, sf_dir, "documents")))
    sources, starts = plan_mix(rows)
    return mix(rows, sources, starts).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ' ' || md5(coalesce(text, ''))) AS hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, sid) AS i FROM w
), c AS (
  SELECT *, (SELECT sum(source_size) FROM w)
              - coalesce(3 * sum(source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY i DESC) AS left_weight
  FROM o
), l AS (
  SELECT rest, left_weight FROM c
  WHERE CAST(3 * source_size AS DOUBLE) >= CAST(rest AS DOUBLE) * weight / left_weight ORDER BY i LIMIT 1
), t AS (
  SELECT w.source, w.sid, w.source_size,
         least(CAST(3 * source_size AS DOUBLE), CAST(l.rest AS DOUBLE) * weight / l.left_weight) AS target
  FROM w, l
), k AS (
  SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, d.hash, t.source, t.sid, t.source_size, t.target,
         CAST(('0x' || substr(md5(coalesce('s' || t.source, 'n')), 1, 8)) AS BIGINT) / 4294967296.0 AS u,
         d.size > greatest(t.target * CAST(0.01 AS DOUBLE), t.source_size * CAST(0.002 AS DOUBLE)) AS large
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), a AS (
  SELECT *, row_number() OVER (PARTITION BY sid ORDER BY size DESC, hash, doc_id) AS pos FROM k WHERE large
), walk AS (
  SELECT DISTINCT sid, CAST(0 AS BIGINT) AS pos, CAST(u AS DOUBLE) AS prefix,
         CAST(0 AS DOUBLE) AS got, CAST(0 AS DOUBLE) AS seen, CAST(0 AS BIGINT) AS copies
  FROM k
  UNION ALL
  SELECT sid, pos, prefix + e, got + (floor(prefix + e) - floor(prefix)) * size, seen + size,
         CAST(floor(prefix + e) - floor(prefix) AS BIGINT)
  FROM (
    SELECT *, greatest(least(3::DOUBLE, greatest(0::DOUBLE, floor((opened - 3 * after) / size + 0.5::DOUBLE))),
                       least(least(3::DOUBLE, greatest(0::DOUBLE, opened / (after + size))), floor(opened / size))) AS e
    FROM (
      SELECT walk.sid, a.pos, walk.prefix, walk.got, walk.seen, CAST(a.size AS DOUBLE) AS size,
             a.target - walk.got AS opened, a.source_size - walk.seen - a.size AS after
      FROM walk JOIN a ON a.sid = walk.sid AND a.pos = walk.pos + 1
    )
  )
), last AS (
  SELECT sid, arg_max(prefix, pos) AS prefix, arg_max(got, pos) AS got, arg_max(seen, pos) AS seen FROM walk GROUP BY sid
), b AS (
  SELECT k.*, l.prefix,
         CASE WHEN k.source_size - l.seen > 0
              THEN least(3::DOUBLE, greatest(0::DOUBLE, (k.target - l.got) / (k.source_size - l.seen)))
              ELSE 0 END AS rest_ratio,
         row_number() OVER (PARTITION BY k.sid ORDER BY floor(sqrt(k.size)), k.hash, k.doc_id) AS pos
  FROM k JOIN last l ON k.sid = l.sid WHERE NOT k.large
)
SELECT a.doc_id, a.size, a.source_size, a.target, a.size * walk.copies AS taken
FROM a JOIN walk ON a.sid = walk.sid AND a.pos = walk.pos
UNION ALL
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(prefix + rest_ratio * pos) - floor(prefix + rest_ratio * (pos - 1))) AS BIGINT) AS taken
FROM b
"""
