"""Numbering rows in order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareweave.session import checkpoint


#: Rows of a range that one task sorts.
RANGE_ROWS = 1_000_000
#: monotonically_increasing_id() holds the task above these bits and the row below.
ROW_BITS = 33


def numbered(df: DataFrame, seq: str, rows: int = RANGE_ROWS, name: str = "i") -> DataFrame:
    """Add the position, from 1, in the order of the column seq; nulls come first.

    Rows are dealt by ranges of about ``rows`` rows, as many as the table's count asks for,
    and sorted inside; a range's start is the count of the ranges before it, of which there is one row each.
    Ties of seq go by all columns and then by the row's place in the input, which also
    split a value that very many rows share.
    """
    ranges = max(1, -(-df.count() // rows))
    ties = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("__ww_place")]
    placed = df.withColumn("__ww_place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first(seq), *ties]
    dealt = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("__ww_place")
    kept = checkpoint(dealt.withColumn("__ww_at", F.monotonically_increasing_id()))
    part = F.shiftright("__ww_at", ROW_BITS)
    before = Window.orderBy("__ww_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(part.alias("__ww_part")).agg(F.count(F.lit(1)).alias("n"), F.min("__ww_at").alias("__ww_first"))
    starts = starts.select("__ww_part", "__ww_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ww_start"))
    return (
        kept.withColumn("__ww_part", part)
        .join(F.broadcast(starts), "__ww_part")  # one row for each million
        .withColumn(name, F.col("__ww_start") + F.col("__ww_at") - F.col("__ww_first") + 1)
        .drop("__ww_part", "__ww_at", "__ww_first", "__ww_start")
    )


#: What a part is called, by the first row's division.
PART_NAMES = {"P": "가격관리"}
OTHER_PART = "승인관리"


def split_parts(df: DataFrame, seq: str, rows: int = 300, division: str | None = None) -> DataFrame:
    """Add part, from 1, of at most ``rows`` rows each in order, and the part's size.

    With a division column also label: the name for the first row's division, the part's
    number, and its size in parentheses.
    """
    parts = numbered(df, seq).withColumn("part", F.ceil(F.col("i") / rows).cast("long"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("part_size"))
    out = parts.join(sizes, "part").drop("i")
    if division is None:
        return out
    first = df.agg(F.min_by(division, seq).alias("d")).first()["d"]
    name = PART_NAMES.get((first or "").upper(), OTHER_PART)
    return out.withColumn("label", F.concat(F.lit(name), F.col("part").cast("string"), F.lit("("), F.col("part_size").cast("string"), F.lit(")")))
