"""Pairing products with offers, and similarity joins that never pair everything."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareweave.functions.money import prices_compatible
from wareweave.functions.scores import adaptive_weights, score_names, sign_hash
from wareweave.functions.text import FILTER_WORDS, clean_name_match, contains_any
from wareweave.operators.similar import jaccard_pairs, token_sets
from wareweave.operators.tiles import merged, small
from wareweave.session import checkpoint

# Groups of categories that go together; a group's own name is no member.
CATEGORY_GROUPS = {
    "전자제품": ("가전", "디지털", "컴퓨터", "IT기기", "휴대폰", "카메라"),
    "패션": ("의류", "신발", "가방", "액세서리", "쥬얼리"),
    "식품": ("식료품", "음료", "건강식품", "간식"),
    "뷰티": ("화장품", "헤어", "바디", "스킨케어"),
    "생활용품": ("주방", "욕실", "청소", "수납"),
}


def price_band_join(left: DataFrame, right: DataFrame, price: str, other: str, on: list[str], low: float, high: float, most: float = 0.3) -> DataFrame:
    """Rows whose prices are compatible, as an equi-join on buckets of the log price.

    Two prices at most ``most`` apart lie in the same or neighbouring buckets; prices
    that are missing or not positive pass with any and get a bucket that the other side
    joins too.
    """
    step = -math.log(1 - most) * 1.01  # a little wider, for the edges of floating point
    bucket = lambda c: F.when(F.col(c) > 0, F.floor(F.log(F.col(c)) / step).cast("long"))
    mine = F.when(F.col(price) > 0, F.array(*[bucket(price) + d for d in (-1, 0, 1)], F.lit(None).cast("long"))).otherwise(F.array(F.lit(None).cast("long")))
    free = -(10**6)
    a = left.withColumn("__ww_b", F.explode(F.transform(mine, lambda b: F.coalesce(b, F.lit(free)))))
    b = right.withColumn("__ww_b", F.coalesce(bucket(other), F.lit(free)))
    positive = merged(a).join(b, [*on, "__ww_b"]).drop("__ww_b")
    unpriced = merged(left.filter(F.coalesce(price, F.lit(0.0)) <= 0)).join(right.filter(F.col(other) > 0), on)
    fits = prices_compatible(F.col(price), F.col(other), low, high, most)
    return positive.unionByName(unpriced).filter(fits)


def category_pairs(pairs: DataFrame, a: str, b: str, groups: dict[str, tuple[str, ...]] = CATEGORY_GROUPS) -> DataFrame:
    """Pairs whose categories are missing, equal, or members of one group.

    The membership table is fixed and small, so it is broadcast to both sides.
    """
    spark = pairs.sparkSession
    members = spark.createDataFrame([(g, m.lower()) for g, ms in groups.items() for m in ms], "grp string, member string")
    of = members.groupBy("member").agg(F.collect_set("grp").alias("groups"))
    norm = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    joined = (
        pairs.join(F.broadcast(of.select(F.col("member").alias("__ma"), F.col("groups").alias("__ga"))), norm(a) == F.col("__ma"), "left")
        .join(F.broadcast(of.select(F.col("member").alias("__mb"), F.col("groups").alias("__gb"))), norm(b) == F.col("__mb"), "left")
    )
    together = F.coalesce(F.arrays_overlap("__ga", "__gb"), F.lit(False))
    fits = (norm(a) == "") | (norm(b) == "") | (norm(a) == norm(b)) | together
    return joined.filter(fits).drop("__ma", "__mb", "__ga", "__gb")


def jaccard_join(names: DataFrame, name: str, least: float, most: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b: distinct names whose token sets overlap enough (operators/similar.py).

    With ``most``, only each a's best pairs, by similarity.
    """
    found = jaccard_pairs(token_sets(names, name), None, least)
    if most is None:
        return found
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hash_near(vectors: DataFrame, differing: int = 4, whole: int = 3) -> DataFrame:
    """(a, b, similarity): vectors whose 64-bit sign hashes differ in at most so many bits.

    The hash is cut into ``whole`` bands more than bits may differ. A pair agrees on at
    least so many of them, so each choice of ``whole`` bands is a key (27 bits by
    default): a key holds few of even very many hashes. Distinct hashes are joined, and
    vectors of one hash are given as (hash's first, other).
    """
    hashed = vectors.select("vec_id", sign_hash(F.col("embedding")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("vec_id").alias("rep"))
    bands = differing + whole
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    cut = [
        F.struct(F.lit(i).alias("band"), F.col("h").bitwiseAND(F.lit(signed(sum(chosen)))).alias("bits"))
        for i, chosen in enumerate(combinations(masks, whole))
    ]
    keys = first.select("h", "rep", F.inline(F.array(*cut)))
    a, b = (keys.select("band", "bits", F.col("h").alias(f"h{s}"), F.col("rep").alias(s)) for s in "ab")
    apart = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    near = merged(a).join(b, ["band", "bits"]).filter("a < b").filter(apart <= differing)
    near = near.select("a", "b", (1 - apart / 64.0).alias("similarity")).distinct()
    same = merged(hashed).join(first, "h").filter("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("similarity"))
    return near.unionByName(same)


def first_stage(catalog: DataFrame, offers: DataFrame) -> DataFrame:
    """Every product with the cheapest offer of each channel side by side.

    Price, quantity and seller of a channel come from one offer: the cheapest, then the
    one of the smallest quantity, then of the smallest id. Both channels come from one
    scan and one aggregation by product. A price of 0 or none has no percentage.
    """
    offer = F.struct("price", "qty", "offer_id", "seller")
    best = offers.filter(F.col("price").isNotNull()).groupBy("product_id").agg(
        *[F.min(F.when(F.col("channel") == f"c{n}", offer)).alias(f"best_{n}") for n in ("2", "3")]
    )
    out = catalog.select("product_id", "name", "price").join(merged(best), "product_id", "left")
    for n in ("2", "3"):
        price = F.col(f"best_{n}.price")
        diff = price - F.col("price")
        out = out.withColumns(
            {
                f"price_{n}": price,
                f"diff_{n}": diff,
                f"pct_{n}": F.try_divide(diff, F.col("price")) * 100,
                f"qty_{n}": F.col(f"best_{n}.qty").cast("double"),
                f"seller_{n}": F.col(f"best_{n}.seller"),
            }
        )
    return out.drop("best_2", "best_3")


def with_placeholders(products: DataFrame, matches: DataFrame, channel: str) -> DataFrame:
    """Matches of a channel, and a row for each product that has none."""
    mine = matches.filter(F.col("channel") == channel).select("product_id", "offer_id", "price", F.lit("OK").alias("status"))
    none = products.join(mine, "product_id", "left_anti").select(
        "product_id", F.lit(None).cast("long").alias("offer_id"), F.lit(None).cast("double").alias("price"), F.lit("no same product").alias("status")
    )
    return mine.unionByName(none)


def best_match(pairs: DataFrame, k: int = 5, least: float = 0.0, sure: float = 0.7, by: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Of each product's k best pairs, the cheapest sure one, else the best score."""
    top = topk(pairs, k, least, by)
    confident = F.col("combined") > sure
    price = F.when(F.coalesce(F.col("offer_price"), F.lit(0.0)) > 0, F.col("offer_price")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*by).orderBy(
        (~confident).cast("int"), F.when(confident, price).otherwise(0.0), F.desc("combined"), "offer_id", "offer_price", "seller"
    )
    return top.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn", "rank")


def topk(pairs: DataFrame, k: int = 5, least: float = 0.0, by: tuple[str, ...] = ("product_id",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("combined"), "offer_id", "offer_price", "seller")
    kept = pairs.filter(F.col("combined") >= least)
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cheapest(pairs: DataFrame, most: int, keep: Column, page: int = 100, pages: int = 3) -> DataFrame:
    """Candidates in order of price: the first pages, the filter on each page, then the cut."""
    order = Window.partitionBy("product_id").orderBy("offer_price", "offer_id", "seller")
    seen = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= page * pages)
    kept = seen.filter(keep).withColumn("rank", F.row_number().over(order))
    return kept.filter(F.col("rank") <= most)


def match_path(
    products: DataFrame,
    candidates: DataFrame,
    edit,
    k: int = 5,
    least: float = 0.75,
    sure: float = 0.75,
    least_text: float = 0.75,
    least_image: float = 0.75,
    groups: dict[str, tuple[str, ...]] | None = None,
    drop_filter_words: bool = False,
) -> DataFrame:
    """The best candidate of each product and channel, from names to the choice.

    products: product_id, name, category, price. candidates: product_id, offer_id, channel,
    seller, title, offer_category, offer_price, image_sim (null without both images). A
    candidate is not the product itself and, if asked for, has no filter word in its title.
    Pairs pass the categories, the price band, the least text score of their cleaned
    names, found once for each distinct pair of them, and, with images, the least image score.
    The scores are weighed; pairs of at least ``least`` are cut to the k best and reduced to
    the cheapest that is ``sure``, else the best. ``edit`` makes the edit ratio's column of two name columns.
    """
    others = candidates.filter(~F.coalesce(F.col("offer_id").cast("string") == F.col("product_id").cast("string"), F.lit(False)))
    if drop_filter_words:
        others = others.filter(~F.coalesce(contains_any(F.lower("title"), FILTER_WORDS), F.lit(False)))
    paired = price_band_join(products.select("product_id", "name", "category", "price"), others, "price", "offer_price", ["product_id"], 0.0, 1e10)
    paired = category_pairs(paired, "category", "offer_category", groups if groups is not None else CATEGORY_GROUPS)
    scored = score_names(paired.select("name", "title").distinct(), "name", "title", edit, "text_sim", clean_name_match)
    scored = checkpoint(scored.filter(F.col("text_sim") >= least_text))
    seen = paired.filter(F.col("image_sim").isNull() | (F.col("image_sim") >= least_image))
    image = F.coalesce("image_sim", F.lit(0.0))
    weights = adaptive_weights(F.col("text_sim"), image, F.col("image_sim").isNotNull())
    combined = F.col("text_sim") * weights["w_text"] + image * weights["w_image"]
    ready = seen.join(small(scored), ["name", "title"]).withColumn("combined", F.round(combined, 9))
    return best_match(ready, k, least, sure, ("product_id", "channel"))
