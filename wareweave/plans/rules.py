"""Queries of the predicates and row filters over the first-stage table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareweave.functions.text import FILTER_WORDS, contains_any
from wareweave.operators import rules
from wareweave.plans.views import oracle, view
from wareweave.sources.sheets import missing_columns

QUERIES: dict = {}


def _over(name: str, source: str, run, sql: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: run(view(spark, sf_dir, source)), oracle(source, sql))


_UNDER = "(coalesce(diff_2 < 0, false) OR coalesce(diff_3 < 0, false))"
_OK2 = "(coalesce(diff_2 < 0, false) AND NOT coalesce(abs(pct_2) <= 1, false))"
_OK3 = "(coalesce(diff_3 < 0, false) AND NOT (qty_3 IS NULL AND coalesce(abs(pct_3) <= 10, false)))"
_COLS = ("price", "diff", "pct", "qty", "seller")


def _cells(ok2: str, ok3: str) -> str:
    return ", ".join([f"CASE WHEN {ok2} THEN {c}_2 END AS {c}_2" for c in _COLS] + [f"CASE WHEN {ok3} THEN {c}_3 END AS {c}_3" for c in _COLS])


_over("filter_undercut", "first_stage", lambda df: df.filter(rules.undercut()), f"SELECT * FROM first_stage WHERE {_UNDER}")
_over("validity_flags", "first_stage", lambda df: df.select("product_id", rules.valid_2().alias("ok_2"), rules.valid_3().alias("ok_3")), f"SELECT product_id, {_OK2} AS ok_2, {_OK3} AS ok_3 FROM first_stage")
_over("second_stage", "first_stage", rules.second_stage, f"SELECT product_id, name, price, {_cells(_OK2, _OK3)} FROM first_stage WHERE {_OK2} OR {_OK3}")
_over("second_stage_strict", "first_stage", rules.second_stage_strict,
      f"SELECT * FROM first_stage WHERE {_UNDER} AND NOT (qty_3 IS NULL AND coalesce(abs(pct_3) <= 10, false)) AND NOT coalesce(abs(pct_2) <= 1, false) AND NOT (coalesce(diff_2 > 0, false) OR coalesce(diff_3 > 0, false))")
_OUT2 = "NOT (coalesce(diff_2 >= 0, false) OR coalesce(pct_2 > -1, false))"
_OUT3 = "NOT (coalesce(diff_3 >= 0, false) OR coalesce(pct_3 > -1, false) OR (qty_3 IS NULL AND coalesce(pct_3 > -10, false) AND NOT coalesce(contains(seller_3, '7'), false)))"
_CELLS = "product_id, name, price, " + _cells(_OUT2, _OUT3)
_over("second_stage_cells", "first_stage",
      lambda df: rules.second_stage_cells(df.withColumn("qty_2", F.when(F.col("product_id") % 7 == 0, "품절").otherwise(F.col("qty_2").cast("string"))), contains_any(F.col("seller_3"), ("7",))),
      f"SELECT * FROM (SELECT {_CELLS} FROM (SELECT * REPLACE (CASE WHEN product_id % 7 <> 0 THEN qty_2 END AS qty_2) FROM first_stage)) WHERE coalesce(price_2, diff_2, pct_2, qty_2, price_3, diff_3, pct_3, qty_3) IS NOT NULL OR coalesce(seller_2, seller_3) IS NOT NULL")
_over("drop_sold_out", "messy",
      lambda df: df.filter(~rules.true(F.col("raw_stock").contains("품절"))).select("product_id", F.when(F.col("raw_url").rlike("^https?://"), F.col("raw_url")).alias("link"), F.when(F.col("raw_price") == "-", "").otherwise(F.col("raw_price")).alias("raw_price")),
      "SELECT product_id, CASE WHEN regexp_matches(raw_url, '^https?://') THEN raw_url END AS link, CASE WHEN raw_price = '-' THEN '' ELSE raw_price END AS raw_price FROM messy WHERE NOT contains(raw_stock, '품절')")
#: Upload names of the columns that exist, in order.
UPLOAD = {"product_id": "code", "name": "product", "price": "our_price", "missing": "never", "price_2": "price_a", "pct_2": "gap_a", "price_3": "price_b", "pct_3": "gap_b"}
_over("upload_projection", "first_stage", lambda df: df.select(*[F.col(c).alias(n) for c, n in UPLOAD.items() if c in df.columns]),
      "SELECT product_id AS code, name AS product, price AS our_price, price_2 AS price_a, pct_2 AS gap_a, price_3 AS price_b, pct_3 AS gap_b FROM first_stage")
_over("discover_diff_cols", "first_stage", lambda df: df.select("product_id", *[c for c in df.columns if "diff" in c and "pct" not in c]), "SELECT product_id, diff_2, diff_3 FROM first_stage")
_over("reference_price_filter", "pairs", lambda df: rules.reference_price(df.withColumn("ref", F.expr("CASE WHEN product_id % 50 = 0 THEN NULL WHEN product_id % 50 = 1 THEN 0.0E0 ELSE price END")), "ref", "offer_price").select("offer_id", "product_id", "offer_price"),
      "SELECT offer_id, product_id, offer_price FROM (SELECT *, CASE WHEN product_id % 50 = 0 THEN NULL WHEN product_id % 50 = 1 THEN 0.0E0 ELSE price END AS ref FROM pairs) WHERE offer_price > 0 AND (coalesce(ref, 0) <= 0 OR (offer_price - ref) / nullif(ref, 0) * 100 < 0 OR (offer_price - ref) / nullif(ref, 0) * 100 >= 10)")
_STATE = "CASE offer_id % 9 WHEN 0 THEN 'Extraction Failed' WHEN 1 THEN 'Image Not Found' ELSE 'OK' END"
_LOW = "'Low Similarity (' || printf('%.2f', text_sim) || ' < 0.75)'"
_FAR = "'Price Out of Range (200~4000)'"
_over("match_status", "pairs", lambda df: df.select("offer_id", "product_id", "seller", rules.match_status(F.col("text_sim"), F.col("offer_price"), F.expr(_STATE), 200, 4000).alias("status")),
      f"""SELECT offer_id, product_id, seller, CASE WHEN offer_price IS NULL THEN '{rules.NO_MATCH}' WHEN offer_id % 9 = 0 THEN '{rules.EXTRACTION_FAILED}' ELSE coalesce(nullif(concat_ws(' / ', CASE WHEN offer_id % 9 = 1 THEN '{rules.NO_IMAGE}' END,
      CASE WHEN offer_price < 200 OR offer_price > 4000 THEN {_FAR} END, CASE WHEN text_sim < 0.75E0 THEN {_LOW} END), ''), 'OK') END AS status FROM pairs""")  # fmt: skip
_over("highlight_flag", "first_stage", lambda df: df.select("product_id", rules.undercut().alias("highlight")), f"SELECT product_id, {_UNDER} AS highlight FROM first_stage")
_over("issue_class", "pairs", lambda df: df.select("offer_id", rules.issue_class(F.try_divide(F.col("offer_price") - F.col("price"), F.col("price")) * 100, F.col("stock"), F.lit("F")).alias("issue")),
      "SELECT offer_id, CASE WHEN abs((offer_price - price) / price * 100) > 10 AND stock <> 'F' THEN 'both' WHEN abs((offer_price - price) / price * 100) > 10 THEN 'price' WHEN stock <> 'F' THEN 'stock' ELSE 'normal' END AS issue FROM pairs")
_over("dedup_keep_first", "messy", lambda df: rules.keep_first(df.select("name", "product_id", "brand"), "name", "product_id"),
      "SELECT name, product_id, brand FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY product_id) AS rn FROM messy) WHERE rn = 1")
_over("keyword_filter", "messy", lambda df: df.filter(~contains_any(F.col("title"), FILTER_WORDS)).select("product_id", "title"),
      f"SELECT product_id, title FROM messy WHERE NOT regexp_matches(title, '{'|'.join(FILTER_WORDS)}')")
_over("quality_metrics", "messy",
      lambda df: df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.trim("raw_code") == "").alias("empty_codes"), F.count_if(~F.col("price").between(0.0, 1000.0)).alias("price_out"), F.count_if(~F.col("raw_url").rlike("^https?://")).alias("bad_urls"), F.count_if(~F.col("division").isin("A", "P")).alias("bad_divisions"),
                        F.count_if(F.coalesce(F.trim("name"), F.lit("")) == "").alias("empty_names"), F.count_if(~F.concat("brand", F.lit("/"), "raw_url").rlike("^https?://")).alias("bad_images"), F.lit(",".join(missing_columns(df, ("name", "price", "본사 이미지")))).alias("missing")),
      "SELECT count(*) AS n_rows, CAST(count_if(trim(raw_code) = '') AS BIGINT) AS empty_codes, CAST(count_if(NOT price BETWEEN 0.0 AND 1000.0) AS BIGINT) AS price_out, CAST(count_if(NOT regexp_matches(raw_url, '^https?://')) AS BIGINT) AS bad_urls, CAST(count_if(division NOT IN ('A', 'P')) AS BIGINT) AS bad_divisions, CAST(count_if(coalesce(trim(name), '') = '') AS BIGINT) AS empty_names, CAST(count_if(NOT regexp_matches(brand || '/' || raw_url, '^https?://')) AS BIGINT) AS bad_images, '본사 이미지' AS missing FROM messy")
_NAME = "CASE WHEN product_id % 11 = 0 THEN ' ' ELSE name END"
_over("enrich_status", "first_stage",
      lambda df: df.withColumn("name", F.expr(_NAME)).withColumn("price_2", F.when(F.col("diff_2") < -500, F.col("price_2")))
      .select("product_id", rules.enrich_status(F.col("name"), F.col("price_2"), F.lit("OK"), F.col("product_id") % 10 / 10.0).alias("status"), F.when(F.trim("name") != "", F.col("price_2")).alias("price_2")),
      f"SELECT product_id, CASE WHEN product_id % 11 = 0 THEN '{rules.NO_NAME}' WHEN NOT coalesce(diff_2 < -500, false) THEN '{rules.NO_PRODUCT}' WHEN product_id % 10 < 6 THEN '{rules.LOW_TEXT}' ELSE 'OK' END AS status, CASE WHEN product_id % 11 <> 0 AND diff_2 < -500 THEN price_2 END AS price_2 FROM first_stage")


def _upload(df):
    """A first-stage sheet under its own headers, some columns missing, as the upload sheet."""
    formula = lambda ext: F.format_string('=IMAGE("https://img.example.com/%d.' + ext + '", 2)', "product_id")
    image = F.when(F.col("product_id") % 3 == 0, formula("jpg")).when(F.col("product_id") % 3 == 1, "nan").otherwise("https://img.example.com/x.png")
    return rules.upload_sheet(
        df.select(
            image.alias("본사 이미지"), F.col("price_3").alias("판매단가(V포함)(3)"), F.col("product_id").alias("상품Code"), F.col("name").alias("상품명"), F.col("seller_3").alias("공급사명"),
            F.col("price").alias("판매단가(V포함)"), F.col("diff_2").alias("가격차이(2)"), F.col("pct_2").alias("가격차이(2)%"), F.lit("memo").alias("memo"),
        )
    )


_over("upload_sheet", "first_stage", _upload,
      """SELECT product_id AS "상품코드", name AS "상품명", price AS "판매단가1(VAT포함)", diff_2 AS "고려 가격차이", pct_2 AS "고려 가격차이(%)", price_3 AS "판매단가3(VAT포함)", seller_3 AS "네이버 공급사명",
      CASE product_id % 3 WHEN 0 THEN 'https://img.example.com/' || CAST(product_id AS STRING) || '.jpg' WHEN 1 THEN '' ELSE 'https://img.example.com/x.png' END AS "본사(이미지링크)" FROM first_stage""")  # fmt: skip
