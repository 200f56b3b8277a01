"""Aggregations over matches, tiers and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean(c: Column) -> Column:
    """The mean to six places, which the order of the rows does not reach."""
    return F.round(F.avg(c), 6)


def price_map(tiers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, tiers: quantity -> unit price as a map; of repeated quantities the last row stays."""
    last = Window.partitionBy(key, "qty").orderBy(*[F.desc(c) for c in order])
    one = tiers.withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    return one.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qty", "unit_price")))).alias("tiers"))


def full_price_map(tiers: DataFrame, products: DataFrame, key: str, price: str, order: list[str]) -> DataFrame:
    """key, tiers for every product; one without tiers has its own price for a quantity of 1, or nothing if it has none above 0."""
    known = products.select(key, price).join(price_map(tiers, key, order), key, "left")
    one = F.when(F.col(price) > 0, F.create_map(F.lit(1), F.col(price)))
    empty = F.create_map().cast("map<int,double>")
    return known.select(key, F.coalesce("tiers", one, empty).alias("tiers"))


def tier_coverage(tiers: DataFrame, key: str, expected: list[int]) -> DataFrame:
    """Share of the expected quantities that a product offers, those missing, those extra."""
    want = F.array(*map(F.lit, expected))
    have = F.collect_set("qty")
    found = tiers.groupBy(key).agg(have.alias("have"))
    text = lambda a: F.array_join(F.array_sort(a), ",")
    return found.select(
        key,
        (F.size(F.array_intersect(want, "have")) / len(expected)).alias("coverage"),
        text(F.array_except(want, "have")).alias("missing"),
        text(F.array_except("have", want)).alias("extra"),
    )
