"""Exact dedup with a heavy-hitter split.

Frequent digests are found with Misra-Gries summaries, one per task, merged by a
sum. The exact size and winner of each candidate come from one partial-aggregated
pass, and the verified winners, at most ``counters`` rows, are broadcast: rows of a
frequent digest that lose are settled where they were read and never shuffled.
All other digests have at most about rows/counters copies and use an ordinary
shuffle on the digest.

Defined cases: a null text equals the empty text; texts of white space only equal
it too; rows that tie in length and doc_id (repeated rows) keep exactly one row; a
null doc_id sorts last; an empty table gives an empty result; input columns named
like an output column are replaced, all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareweave.llm.common import BLANKS, checkpoint, shield, table, unshield, whole_text, without

#: Counters of each Misra-Gries summary and bound of the broadcast winners.
COUNTERS = 1024
ADDED = ("keep_id", "group_size", "kept", "text_sha256")
CHARS = "__ww_chars"
#: Other names that the split uses on the way.
WORKING = ("heavy_id", "heavy_chars", "heavy_size")


def with_digest(docs: DataFrame) -> DataFrame:
    """Add text_sha256 of the text without ASCII white space, and its code points."""
    text = whole_text()
    return (
        without(docs, *ADDED, *WORKING, CHARS)
        .withColumn(CHARS, F.char_length(text))
        .withColumn("text_sha256", F.sha2(F.regexp_replace(text, BLANKS, ""), 256))
    )


def _shrink(counts: dict[str, int], k: int) -> dict[str, int]:
    """Merge step of Misra-Gries: take the (k+1)th largest count off every counter."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: n - cut for d, n in counts.items() if n > cut}


def misra_gries(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Candidates for frequent values of the single string column, at most k rows.

    A value with more than 2/(k+1) of all rows is always among them.
    """
    name = digests.columns[0]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            tally = pc.value_counts(batch.column(0))
            for digest, n in zip(tally.field("values").to_pylist(), tally.field("counts").to_pylist(), strict=True):
                counts[digest] = counts.get(digest, 0) + n
            counts = _shrink(counts, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[name, "n"]
        )

    return (
        digests.mapInArrow(summarise, f"`{name}` string, n long")
        .groupBy(name)
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), name)
        .limit(k)
        .select(name)
    )


def heavy_winners(keyed: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Verified winner and size of each frequent digest: at most k rows."""
    candidates = F.broadcast(misra_gries(keyed.select("text_sha256"), k))
    order = F.struct(
        (-F.col(CHARS)).alias("short"), F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("doc_id")
    )
    return checkpoint(
        keyed.select("doc_id", CHARS, "text_sha256")
        .join(candidates, "text_sha256")
        .groupBy("text_sha256")
        .agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("heavy_size"))
        .filter("heavy_size > 1")
        .select(
            "text_sha256",
            F.col("best.doc_id").alias("heavy_id"),
            (-F.col("best.short")).alias("heavy_chars"),
            "heavy_size",
        )
    )


def resolve(keyed: DataFrame, winners: DataFrame) -> DataFrame:
    """Settle every row of a keyed table, given the broadcast winners.

    Only rows of light digests and the winning rows of heavy ones are shuffled.
    """
    joined = keyed.join(F.broadcast(winners), "text_sha256", "left")
    wins = F.col("doc_id").eqNullSafe(F.col("heavy_id")) & (F.col(CHARS) == F.col("heavy_chars"))
    contender = F.col("heavy_size").isNull() | wins
    group = Window.partitionBy("text_sha256")
    ranked = group.orderBy(F.desc(CHARS), F.asc_nulls_last("doc_id"))
    settled = (
        joined.filter(contender)
        .withColumn("keep_id", F.first("doc_id").over(ranked))
        .withColumn("kept", F.row_number().over(ranked) == 1)
        .withColumn("group_size", F.coalesce("heavy_size", F.count(F.lit(1)).over(group)))
    )
    lost = (
        joined.filter(~contender)
        .withColumn("keep_id", F.col("heavy_id"))
        .withColumn("kept", F.lit(False))
        .withColumn("group_size", F.col("heavy_size"))
    )
    return settled.unionByName(lost).drop("heavy_id", "heavy_chars", "heavy_size", CHARS)


def exact_dedup(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """All rows and columns of docs plus keep_id, group_size, kept, text_sha256."""
    keyed = with_digest(docs)
    narrow = checkpoint(keyed.select("doc_id", CHARS, "text_sha256"))
    return resolve(keyed, heavy_winners(narrow, k))


def keep_one(docs: DataFrame, k: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    found = exact_dedup(shield(docs, *ADDED, *WORKING), k)
    return unshield(found.filter("kept"), docs.columns)


def dedup_query(spark, sf_dir: str) -> DataFrame:
    keyed = checkpoint(with_digest(table(spark, sf_dir, "documents")).select("doc_id", CHARS, "text_sha256"))
    return resolve(keyed, heavy_winners(keyed)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS rn,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
