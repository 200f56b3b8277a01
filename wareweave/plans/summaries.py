"""Queries of the aggregations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareweave.operators.summaries import full_price_map, mean, price_map, tier_coverage
from wareweave.plans.views import oracle, view
from wareweave.session import table

QUERIES: dict = {}
EXPECTED = [1, 5, 10, 20, 30, 40, 50]


def _over(name: str, source: str, run, sql: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: run(view(spark, sf_dir, source)), oracle(source, sql))


def _tiers(df):
    return df.select("product_id", "qty", F.col("price").alias("unit_price"), "offer_id", "supplier_id")


_MEAN = "round(avg({0}), 6)"
_over("price_summary", "pairs",
      lambda df: df.withColumn("diff", F.col("offer_price") - F.col("price")).withColumn("pct", F.try_divide("diff", "price") * 100)
      .groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("diff") < 0).alias("cheaper"), mean(F.col("diff")).alias("mean_diff"), F.max("diff").alias("max_diff"), F.min("diff").alias("min_diff"), mean(F.col("pct")).alias("mean_pct")),
      f"SELECT channel, count(*) AS n, CAST(count_if(offer_price - price < 0) AS BIGINT) AS cheaper, {_MEAN.format('offer_price - price')} AS mean_diff, max(offer_price - price) AS max_diff, min(offer_price - price) AS min_diff, {_MEAN.format('(offer_price - price) / nullif(price, 0) * 100')} AS mean_pct FROM pairs GROUP BY channel")
_over("issue_stats", "pairs",
      lambda df: df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.try_divide(F.abs(F.col("offer_price") - F.col("price")), F.col("price")) > 0.1).alias("price_issues"), F.count_if(F.col("stock") != "F").alias("stock_issues"), F.count_if(~F.col("has_images")).alias("unmatched")),
      "SELECT count(*) AS total, CAST(count_if(abs(offer_price - price) / nullif(price, 0) > 0.1E0) AS BIGINT) AS price_issues, CAST(count_if(stock <> 'F') AS BIGINT) AS stock_issues, CAST(count_if(NOT has_images) AS BIGINT) AS unmatched FROM pairs")
_over("match_coverage", "first_stage", lambda df: df.agg(F.count(F.lit(1)).alias("n_products"), F.count("price_2").alias("matched_2"), F.count("price_3").alias("matched_3"), F.count_if(F.col("price_2").isNotNull() & F.col("price_3").isNotNull()).alias("matched_both")),
      "SELECT count(*) AS n_products, count(price_2) AS matched_2, count(price_3) AS matched_3, CAST(count_if(price_2 IS NOT NULL AND price_3 IS NOT NULL) AS BIGINT) AS matched_both FROM first_stage")
QUERIES["request_rates"] = (
    lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.count_if(F.col("event_type") != "error") * 100.0 / F.count(F.lit(1))).alias("success_rate"),
        (F.count_if(F.col("event_type") == "purchase") * 100.0 / F.nullif(F.count_if(F.col("event_type") != "error"), F.lit(0))).alias("hit_rate"),
    ),
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, CAST(count_if(event_type <> 'error') AS DOUBLE) * 100.0E0 / count(*) AS success_rate, CAST(count_if(event_type = 'purchase') AS DOUBLE) * 100.0E0 / nullif(count_if(event_type <> 'error'), 0) AS hit_rate FROM events GROUP BY 1",
)
_over("quantity_price_map", "offers",
      lambda df: price_map(_tiers(df), "product_id", ["offer_id", "unit_price", "supplier_id"]).select("product_id", F.size("tiers").alias("n_tiers"), F.array_join(F.transform(F.map_keys("tiers"), lambda q: q.cast("string")), ",").alias("quantities"), F.map_values("tiers")[0].alias("first_price")),
      """SELECT product_id, count(*)::INT AS n_tiers, string_agg(CAST(qty AS VARCHAR), ',' ORDER BY qty) AS quantities, arg_min(price, qty) AS first_price FROM (SELECT *, row_number() OVER (PARTITION BY product_id, qty ORDER BY offer_id DESC, price DESC, supplier_id DESC) AS rn FROM offers) WHERE rn = 1 GROUP BY product_id""")  # fmt: skip
_over("max_similarity", "pairs", lambda df: df.groupBy("product_id").agg(F.max("text_sim").alias("best"), F.max_by("offer_id", F.struct("text_sim", -F.col("offer_id"))).alias("best_offer")),
      "SELECT product_id, max(text_sim) AS best, min(offer_id) FILTER (text_sim = top) AS best_offer FROM (SELECT *, max(text_sim) OVER (PARTITION BY product_id) AS top FROM pairs) GROUP BY product_id")
_over("matched_id_list", "pairs",
      lambda df: df.groupBy("product_id").agg(F.array_sort(F.collect_set(F.when(F.col("text_sim") > 0.9, F.col("offer_id")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("image_sim") > 0.5, F.col("offer_id")))).alias("b"))
      .select("product_id", F.coalesce(F.nullif(F.array_join(F.transform("a", lambda x: x.cast("string")), ","), F.lit("")), F.array_join(F.transform("b", lambda x: x.cast("string")), ",")).alias("ids")),
      "SELECT product_id, coalesce(string_agg(DISTINCT CAST(offer_id AS VARCHAR), ',' ORDER BY lpad(CAST(offer_id AS VARCHAR), 20, '0')) FILTER (text_sim > 0.9E0), string_agg(DISTINCT CAST(offer_id AS VARCHAR), ',' ORDER BY lpad(CAST(offer_id AS VARCHAR), 20, '0')) FILTER (image_sim > 0.5E0), '') AS ids FROM pairs GROUP BY product_id".replace("DISTINCT CAST(offer_id AS VARCHAR), ',' ORDER BY lpad(CAST(offer_id AS VARCHAR), 20, '0')", "CAST(offer_id AS VARCHAR), ',' ORDER BY offer_id").replace("FROM pairs", "FROM (SELECT DISTINCT product_id, offer_id, text_sim, image_sim FROM pairs)"))
_over("nested_matches", "pairs",
      lambda df: df.groupBy("product_id").agg(F.array_sort(F.collect_list(F.when(F.col("channel") == "c2", F.struct("offer_id", "text_sim")))).alias("c2"), F.array_sort(F.collect_list(F.when(F.col("channel") == "c3", F.struct("offer_id", "text_sim")))).alias("c3"))
      .select("product_id", F.size("c2").alias("n_2"), F.size("c3").alias("n_3"), F.size(F.concat("c2", "c3")).alias("n_all"), F.get("c2", F.lit(0))["offer_id"].alias("first_2")),
      "SELECT product_id, CAST(count_if(channel = 'c2') AS BIGINT)::INT AS n_2, CAST(count_if(channel = 'c3') AS BIGINT)::INT AS n_3, count(*)::INT AS n_all, min(offer_id) FILTER (channel = 'c2') AS first_2 FROM pairs GROUP BY product_id")
_over("tier_coverage", "offers", lambda df: tier_coverage(_tiers(df), "product_id", EXPECTED),
      f"SELECT product_id, len(list_intersect({EXPECTED}, have)) / {len(EXPECTED)}.0E0 AS coverage, array_to_string(list_sort(list_filter({EXPECTED}, lambda q: NOT list_contains(have, q))), ',') AS missing, array_to_string(list_sort(list_filter(have, lambda q: NOT list_contains({EXPECTED}, q))), ',') AS extra FROM (SELECT product_id, list(DISTINCT qty) AS have FROM offers GROUP BY product_id)")
_over("all_matches_union", "pairs", lambda df: df.filter("channel = 'c2'").unionByName(df.filter("channel = 'c3'")).select("offer_id", "product_id", "channel"), "SELECT offer_id, product_id, channel FROM pairs WHERE channel = 'c2' UNION ALL SELECT offer_id, product_id, channel FROM pairs WHERE channel = 'c3'")
_over("merge_unique", "messy", lambda df: df.select("product_id", F.array_join(F.array_distinct(F.filter(F.flatten(F.array(F.array("name", "raw_url", "brand"), F.array("brand", "name", "category"))), lambda u: F.trim(u) != "")), ",").alias("merged")),
      "SELECT product_id, name || CASE WHEN trim(raw_url) <> '' THEN ',' || raw_url ELSE '' END || ',' || brand || ',' || category AS merged FROM messy")


def _all_tiers(spark, sf_dir):
    """Every product's tiers of less than five pieces, as text; its own price where it has none."""
    products = view(spark, sf_dir, "catalog").withColumn("price", F.when(F.col("product_id") % 17 > 0, F.col("price")))
    found = full_price_map(_tiers(view(spark, sf_dir, "offers").filter("qty < 2")), products, "product_id", "price", ["offer_id", "unit_price", "supplier_id"])
    text = F.transform(F.map_entries("tiers"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.round(e["value"], 2).cast("decimal(18,2)").cast("string")))
    return found.select("product_id", F.array_join(text, ",").alias("tiers"))


QUERIES["quantity_price_map_all"] = (
    _all_tiers,
    f"""{oracle('catalog', '').strip()}, {oracle('offers', '').strip().removeprefix('WITH ')},
    t AS (SELECT product_id, string_agg(CAST(qty AS VARCHAR) || '=' || CAST(CAST(round(price, 2) AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY qty) AS tiers FROM (
      SELECT *, row_number() OVER (PARTITION BY product_id, qty ORDER BY offer_id DESC, price DESC, supplier_id DESC) AS rn FROM offers WHERE qty < 2) WHERE rn = 1 GROUP BY product_id)
    SELECT product_id, coalesce(tiers, CASE WHEN product_id % 17 > 0 AND price > 0 THEN '1=' || CAST(CAST(round(price, 2) AS DECIMAL(18,2)) AS VARCHAR) ELSE '' END) AS tiers FROM catalog LEFT JOIN t USING (product_id)""",
)
_over("nested_matches_json", "pairs",
      lambda df: df.groupBy("product_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.struct("offer_id", F.col("qty").alias("qty"))))).alias(c) for c in ("c2", "c3")])
      .select("product_id", F.to_json(F.struct("c2", "c3", F.concat("c2", "c3").alias("all"))).alias("matches")),
      """SELECT product_id, '{"c2":[' || coalesce(a, '') || '],"c3":[' || coalesce(b, '') || '],"all":[' || concat_ws(',', a, b) || ']}' AS matches FROM (
      SELECT product_id, string_agg(j, ',' ORDER BY offer_id, qty) FILTER (channel = 'c2') AS a, string_agg(j, ',' ORDER BY offer_id, qty) FILTER (channel = 'c3') AS b
      FROM (SELECT *, '{"offer_id":' || CAST(offer_id AS VARCHAR) || ',"qty":' || CAST(qty AS VARCHAR) || '}' AS j FROM pairs) GROUP BY product_id)""")  # fmt: skip
