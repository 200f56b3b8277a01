"""Equi-joins whose hot keys are cut into tiles, so that no task meets a whole hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareweave.session import checkpoint

#: Rows of either side that meet in one tile.
TILE_ROWS = 4096
#: Pairs that a task makes where their number is known.
TASK_PAIRS = 2_000_000
#: Hot keys up to which their table is broadcast; beyond it they are joined.
BROADCAST_KEYS = 10_000


def merged(df: DataFrame) -> DataFrame:
    """A side that grows with the input: sorted and merged, whatever its file's size promises.

    An explosion keeps its input's estimate and a shuffle is measured compressed, so Spark
    would broadcast sides of many times its threshold.
    """
    return df.hint("merge")


def hot_keys(a: DataFrame, b: DataFrame, on: list[str], rows: int = TILE_ROWS) -> DataFrame:
    """Keys of both sides that more rows than a tile's have, with each side's parts.

    There is at most one such key for every ``rows`` rows.
    """
    counts = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    both = merged(counts(a, "__ww_na")).join(counts(b, "__ww_nb"), on)
    parts = lambda n: F.ceil(F.col(n) / rows).cast("int")
    return both.filter(F.greatest("__ww_na", "__ww_nb") > rows).select(*on, parts("__ww_na").alias("__ww_pa"), parts("__ww_nb").alias("__ww_pb"))


def small(written: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it has few rows and merged otherwise."""
    return F.broadcast(written) if written.count() <= BROADCAST_KEYS else merged(written)


def _dealt(side: DataFrame, hot: DataFrame, on: list[str], row: list[Column], mine: str, theirs: str) -> DataFrame:
    """A side's rows of hot keys, each in its own part and copied to all of the other side's."""
    part = lambda c: F.coalesce(F.col(c), F.lit(1))
    own, other = {"__ww_pa": ("__ww_i", "__ww_j"), "__ww_pb": ("__ww_j", "__ww_i")}[mine]
    dealt = side.join(hot, on, "left").withColumn(own, F.pmod(F.xxhash64(*row), part(mine)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), part(theirs) - 1))).drop("__ww_pa", "__ww_pb")


def tiled(a: DataFrame, b: DataFrame, on: list[str], row_a: list[Column], row_b: list[Column], rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with two tile columns, and the columns to join on.

    Every pair of rows of equal keys meets in exactly one tile. row_a and row_b tell a
    key's rows apart. Copies are a share 1/rows of the pairs that meet anyway.
    """
    hot = small(checkpoint(hot_keys(a, b, on, rows)))
    left = _dealt(a, hot, on, row_a, "__ww_pa", "__ww_pb")
    right = _dealt(b, hot, on, row_b, "__ww_pb", "__ww_pa")
    return left, right, [*on, "__ww_i", "__ww_j"]


def tiled_join(
    a: DataFrame, b: DataFrame, on: list[str], row_a: list[Column], row_b: list[Column], rows: int = TILE_ROWS, tasks: int | None = None
) -> DataFrame:
    """The inner equi-join of two sides, hot keys in tiles; tasks, if given, is the number that the keys are dealt to."""
    left, right, keys = tiled(a, b, on, row_a, row_b, rows)
    if tasks:
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return merged(left).join(right, keys).drop("__ww_i", "__ww_j")


def self_tiled(rows: DataFrame, on: list[str], row: list[Column], most: int = TILE_ROWS) -> DataFrame:
    """Rows of keys that several have, with tile, cross and second.

    In a cross tile the rows that are not second meet those that are, in any other all meet
    each other. Every two rows of a key meet in exactly one tile, which holds about 2 * ``most`` rows.
    """
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__ww_n"))
    crowds = counts.filter(F.col("__ww_n") > 1).select(*on, F.ceil(F.col("__ww_n") / most).cast("int").alias("__ww_p"))
    part = F.pmod(F.xxhash64(*row), F.col("__ww_p")).cast("int")
    met = merged(rows).join(crowds, on).withColumn("__ww_own", part)
    met = met.withColumn("__ww_other", F.explode(F.sequence(F.lit(0), F.col("__ww_p") - 1)))
    tile = F.struct(F.least("__ww_own", "__ww_other").alias("i"), F.greatest("__ww_own", "__ww_other").alias("j"))
    own, other = F.col("__ww_own"), F.col("__ww_other")
    return met.withColumns({"tile": tile, "cross": own != other, "second": own > other}).drop("__ww_p", "__ww_own", "__ww_other")
