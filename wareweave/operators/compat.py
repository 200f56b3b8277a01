"""Joins on what goes together: prices within a band, and categories of one group.

Neither needs an equality: prices meet by cells of the log price, categories by the groups
that they are members of. Rows that the rule lets pass with everything are not paired
with everything: a row without a price is given once, without a partner.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareweave.operators.tiles import TASK_PAIRS, TILE_ROWS, merged, tiled_join
from wareweave.session import checkpoint

WILD_LEFT, WILD_RIGHT = "?", "*"


def band_pairs(left: DataFrame, right: DataFrame, price: str, other: str, most: float = 0.3, rows: int = TILE_ROWS) -> DataFrame:
    """All rows of both sides whose prices differ by at most ``most`` of the larger.

    Prices that close lie in the same or neighbouring cells of a grid over the log price, so
    the right side is copied to both neighbours of its cell; crowded cells are cut into
    tiles. Rows with no price, or one that is not above 0, go with any row of the other
    side: they come once each, the other side's columns null. No column may be in both tables.
    """
    if not 0 < most < 1:
        raise ValueError("most must lie between 0 and 1")
    step = -math.log(1 - most) * 1.01  # a little wider, for the edges of floating point
    cell = lambda c: F.floor(F.log(F.col(c)) / step).cast("long")
    priced = lambda df, c: df.filter(F.col(c) > 0)
    free = lambda df, c: df.filter(~F.coalesce(F.col(c) > 0, F.lit(False)))
    a = priced(left, price).withColumn("__ww_cell", cell(price))
    b = priced(right, other).withColumn("__ww_cell", F.explode(F.array(*[cell(other) + d for d in (-1, 0, 1)])))
    met = tiled_join(a, b, ["__ww_cell"], [F.col(c) for c in left.columns], [F.col(c) for c in right.columns], rows).drop("__ww_cell")
    close = F.abs(F.col(price) - F.col(other)) / F.greatest(price, other) <= most
    return (
        met.filter(close)
        .unionByName(free(left, price), allowMissingColumns=True)
        .unionByName(free(right, other), allowMissingColumns=True)
        .select(*left.columns, *right.columns)
    )


def memberships(groups: dict[str, tuple[str, ...]], category: Column) -> Column:
    """The category itself, then the groups it is a member of; null where it is missing.

    The groups are a fixed, short table, so they are constants of the plan.
    """
    name = F.lower(F.trim(category))
    of = [F.when(name.isin(*[m.lower() for m in members]), F.lit(f"group {g}")) for g, members in sorted(groups.items())]
    return F.when(F.coalesce(name, F.lit("")) != "", F.array_compact(F.array(F.concat(F.lit("category "), name), *of)))


def compatible_pairs(left: DataFrame, right: DataFrame, a: str, b: str, groups: dict[str, tuple[str, ...]], on: list[str] | None = None, rows: int = TILE_ROWS) -> DataFrame:
    """Rows of both sides whose categories are missing, equal, or members of one group.

    Each side is posted under its category, its groups and, for partners that have no
    category, a wildcard; a pair counts under the first key that both have, so nothing is
    dropped as a repeat afterwards. ``on`` names columns of both tables that must be equal
    too. Very common categories and wildcards are cut into tiles.
    """
    on = on or []
    mine, theirs = memberships(groups, F.col(a)), memberships(groups, F.col(b))
    left_keys = F.coalesce(F.array_append(mine, WILD_LEFT), F.array(F.lit(WILD_RIGHT)))
    right_keys = F.coalesce(F.array_append(theirs, WILD_RIGHT), F.array(F.lit(WILD_LEFT), F.lit(WILD_RIGHT)))
    posted = lambda df, keys, c: df.withColumn(c, keys).withColumn("__ww_key", F.explode(c))
    met = tiled_join(
        posted(left, left_keys, "__ww_ka"), posted(right, right_keys, "__ww_kb"), [*on, "__ww_key"], [F.col(c) for c in left.columns], [F.col(c) for c in right.columns], rows
    )
    first = F.get(F.array_intersect("__ww_ka", "__ww_kb"), F.lit(0))
    return met.filter(F.col("__ww_key") == first).drop("__ww_key", "__ww_ka", "__ww_kb")


def compatible_rows(left: DataFrame, right: DataFrame, a: str, b: str, groups: dict[str, tuple[str, ...]], on: list[str] | None = None, rows: int = TILE_ROWS) -> DataFrame:
    """The pairs of compatible_pairs, the rule tried for categories that occur together instead of for rows.

    A left row is copied for each category of the right side that it goes with, and what
    then meets is a pair. The pairs are counted before, and dealt out by their number.
    """
    on = on or []
    name = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit(""))
    of = lambda df, c, x: df.groupBy(*on, name(c).alias(f"__ww_{x}")).agg(F.count(F.lit(1)).alias(f"__ww_n{x}"))
    linked = checkpoint(compatible_pairs(of(left, a, "a"), of(right, b, "b"), "__ww_a", "__ww_b", groups, on, rows))
    pairs = linked.agg(F.sum(F.col("__ww_na") * F.col("__ww_nb"))).first()[0] or 0
    mine = left.withColumn("__ww_a", name(a))
    linked = linked.select(*on, "__ww_a", "__ww_b")
    copied = tiled_join(mine, linked, [*on, "__ww_a"], [F.col(c) for c in left.columns], [F.col("__ww_b")], rows).drop("__ww_a")
    theirs = right.withColumn("__ww_b", name(b))
    return tiled_join(copied, theirs, [*on, "__ww_b"], [F.col(c) for c in left.columns], [F.col(c) for c in right.columns], rows, pairs // TASK_PAIRS).drop("__ww_b")


def compatible_members(
    left: DataFrame, right: DataFrame, id_a: str, id_b: str, a: str, b: str, groups: dict[str, tuple[str, ...]], on: list[str] | None = None, rows: int = TILE_ROWS
) -> DataFrame:
    """(kind, id, category, class_id, links): what compatible_pairs finds, without a row for each pair.

    Rows of a side whose ``on`` columns and category agree are a class, named by its least
    id. Kinds ``left`` and ``right`` give every row with its class and the number of
    partners; kind ``pair`` gives every two compatible classes, id of the left one and class_id
    of the right one, with the number of pairs of rows. A row whose ``on`` column is null has no partners.
    """
    on = on or []
    name = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit(""))

    def classes(side: DataFrame, c: str, i: str, x: str) -> DataFrame:
        grouped = side.groupBy(*on, name(c).alias(f"category_{x}")).agg(F.min(i).alias(f"class_{x}"), F.count(F.lit(1)).alias(f"n_{x}"))
        return checkpoint(grouped)

    mine, theirs = classes(left, a, id_a, "a"), classes(right, b, id_b, "b")
    found = checkpoint(compatible_pairs(mine, theirs, "category_a", "category_b", groups, on, rows).select("class_a", "n_a", "class_b", "n_b"))

    def members(side: DataFrame, of: DataFrame, i: str, c: str, x: str, y: str, kind: str) -> DataFrame:
        links = found.groupBy(f"class_{x}").agg(F.sum(f"n_{y}").alias("links"))
        named = of.join(merged(links), f"class_{x}", "left").select(
            *[F.col(k).alias(f"__ww_{k}") for k in on], F.col(f"category_{x}").alias("__ww_name"), F.col(f"class_{x}").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")
        )
        same = name(c) == F.col("__ww_name")
        for k in on:
            same = same & F.col(k).eqNullSafe(F.col(f"__ww_{k}"))
        return side.join(merged(named), same).select(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col(c).alias("category"), "class_id", "links")

    pairs = found.select(F.lit("pair").alias("kind"), F.col("class_a").alias("id"), F.lit(None).cast("string").alias("category"), F.col("class_b").alias("class_id"), (F.col("n_a") * F.col("n_b")).alias("links"))
    return members(left, mine, id_a, a, "a", "b", "left").unionByName(members(right, theirs, id_b, b, "b", "a", "right")).unionByName(pairs)


def category_classes(left: DataFrame, right: DataFrame, a: str, b: str, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(category_a, category_b, n_a, n_b): compatible categories and how many rows each has.

    Rows join their category; missing ones are the category ''. The number of pairs grows
    with the categories, not with the rows.
    """
    name = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit(""))
    of = lambda df, c, x: df.groupBy(name(c).alias(f"category_{x}")).agg(F.count(F.lit(1)).alias(f"n_{x}"))
    return compatible_pairs(of(left, a, "a"), of(right, b, "b"), "category_a", "category_b", groups)
