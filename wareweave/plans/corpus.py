"""Queries of the page-corpus jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wareweave.functions import pages as page
from wareweave.functions.urls import absolute_url
from wareweave.plans.views import oracle, view
from wareweave.session import table

QUERIES: dict = {}
PATTERNS = {"title": r"<title>([^<]*)</title>", "heading": r"<h1>([^<]*)</h1>", "lang": r'<html lang="([a-z]+)"'}
#: Which links count first: patterns in order.
PRIORITY = (r"^/[A-Z]", r"^/[a-z]{4}", r"^/")


def _pages(name: str, run, sql: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: run(table(spark, sf_dir, "pages")), sql)


def _over(name: str, source: str, run, sql: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: run(view(spark, sf_dir, source)), oracle(source, sql))


_pages("extract_fields", lambda df: df.select("page_id", *page.fields(F.col("html"), PATTERNS), *(c.alias(n) for n, c in page.page_flags(F.concat("html", F.lit(" 상품코드: "), "page_id")).items())),
       "SELECT page_id, " + ", ".join(f"nullif(regexp_extract(html, '{p}', 1), '') AS {n}" for n, p in PATTERNS.items()) + ", regexp_matches(lower(html), 'sold out|품절') AS sold_out, regexp_matches(html, '(?i)VAT\\s*(포함|별도|제외)') AS vat_named, nullif(regexp_extract(html || ' 상품코드: ' || CAST(page_id AS VARCHAR), '(?i)(?:product code|item no|상품코드|상품번호)\\s*[:：]?\\s*([A-Za-z0-9-]+)', 1), '') AS code FROM pages")
_HREF = r"regexp_extract_all(html, '\bhref=\"([^\"]*)\"', 1)"
_pages("extract_links",
       lambda df: df.select("page_id", "url", F.explode(page.attribute_values(F.col("html"), "href")).alias("href")).filter(F.col("href") != "").select("page_id", absolute_url(F.col("url"), F.col("href")).alias("link")).distinct(),
       rf"""SELECT DISTINCT page_id, regexp_extract(CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+):', 1) || ':' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href
       ELSE regexp_extract(regexp_extract(url, '^[^?#]*'), '^[a-z]+://[^/]*(?:/.*)?/|^[a-z]+://[^/]*') || CASE WHEN ends_with(regexp_extract(regexp_extract(url, '^[^?#]*'), '^[a-z]+://[^/]*(?:/.*)?/|^[a-z]+://[^/]*'), '/') THEN '' ELSE '/' END || href END, '^[^#]*') AS link FROM (SELECT page_id, url, unnest({_HREF}) AS href FROM pages) WHERE href <> ''""")  # fmt: skip
_pages("canonical_url", lambda df: df.select("page_id", absolute_url(F.col("url"), F.lit("item/1.html#part")).alias("relative"), absolute_url(F.col("url"), F.lit("/top")).alias("rooted"), absolute_url(F.col("url"), F.col("url")).alias("own")),
       r"""SELECT page_id, b || CASE WHEN ends_with(b, '/') THEN '' ELSE '/' END || 'item/1.html' AS relative, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/top' AS rooted, regexp_extract(url, '^[^#]*') AS own
       FROM (SELECT *, regexp_extract(regexp_extract(url, '^[^?#]*'), '^[a-z]+://[^/]*(?:/.*)?/|^[a-z]+://[^/]*') AS b FROM pages)""")  # fmt: skip


def _first_by_priority(df):
    links = df.select("page_id", F.posexplode(page.attribute_values(F.col("html"), "href")).alias("pos", "href"))
    rank = F.lit(len(PRIORITY))
    for i, p in reversed(list(enumerate(PRIORITY))):
        rank = F.when(F.col("href").rlike(p), i).otherwise(rank)
    order = Window.partitionBy("page_id").orderBy("rank", "pos")
    return links.withColumn("rank", rank).withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("page_id", "href", "rank")


_pages("first_by_priority", _first_by_priority,
       f"SELECT page_id, href, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank, pos) AS rn FROM (SELECT page_id, pos, href, CAST(CASE WHEN regexp_matches(href, '{PRIORITY[0]}') THEN 0 WHEN regexp_matches(href, '{PRIORITY[1]}') THEN 1 WHEN regexp_matches(href, '{PRIORITY[2]}') THEN 2 ELSE 3 END AS INT) AS rank FROM (SELECT page_id, unnest({_HREF}) AS href, generate_subscripts({_HREF}, 1) AS pos FROM pages))) WHERE rn = 1")
_over("extract_tiers", "messy",
      lambda df: df.select("product_id", F.explode(page.priced_tiers(F.concat(F.when(F.col("product_id") % 2 == 0, "VAT 포함 ").otherwise(""), F.lit("1개: 1,000원 / "), (F.col("size") + 10).cast("string"), F.lit("개: "), (F.col("size") + 500).cast("string"), F.lit("원")))).alias("t")).select("product_id", "t.qty", "t.price"),
      "SELECT product_id, 1 AS qty, CASE WHEN product_id % 2 = 0 THEN 1000 ELSE CAST(trunc(1000.0E0 * 1.1E0) AS BIGINT) END AS price FROM messy UNION ALL SELECT product_id, CAST(size + 10 AS INT), CASE WHEN product_id % 2 = 0 THEN CAST(size + 500 AS BIGINT) ELSE CAST(trunc(CAST(size + 500 AS DOUBLE) * 1.1E0) AS BIGINT) END FROM messy")
_MARKUP = """html || '<img class="a" src="/p/' || CAST(page_id AS STRING) || '.jpg"><img src="/icon_1.png"><div style="background: url(/q/' || CAST(page_id % 7 AS STRING) || '.webp)">'"""
_pages("extract_images",
       lambda df: df.select("page_id", "url", F.explode(page.image_links(F.expr(_MARKUP))).alias("src")).select("page_id", absolute_url(F.col("url"), F.col("src")).alias("image")).distinct(),
       """SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/p/' || CAST(page_id AS VARCHAR) || '.jpg' AS image FROM pages
       UNION SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/q/' || CAST(page_id % 7 AS VARCHAR) || '.webp' FROM pages""")  # fmt: skip
_over("option_tiers", "messy",
      lambda df: df.select("product_id", F.explode(page.option_tiers(F.concat(F.lit("1:+0;10:-"), F.col("size").cast("string")), F.col("price"))).alias("t")).select("product_id", "t.*"),
      "SELECT product_id, 1 AS qty, price + 0.0E0 AS price, (price + 0.0E0) / 1 AS unit_price FROM messy UNION ALL SELECT product_id, 10, price - size, (price - size) / 10 FROM messy")
_over("spec_map", "messy",
      lambda df: df.select("product_id", page.spec_map(F.concat(F.lit("<tr><th>brand</th><td>"), "brand", F.lit("</td></tr><tr><th>size</th><td>"), F.col("size").cast("string"), F.lit("</td></tr>"))).alias("m")).select("product_id", F.col("m")["brand"].alias("brand"), F.col("m")["size"].alias("size")),
      "SELECT product_id, brand, CAST(size AS STRING) AS size FROM messy")


def _table(qty, prices):
    """Rows of a tier table with a members' row between: each an array with its heading first."""
    row = lambda head, cells: F.array(F.lit(head), *cells)
    return F.array(row(page.QUANTITY, qty), row(page.MEMBER, [F.lit("1")] * len(qty)), row("일반", prices))


def _layouts(df):
    tiers = page.priced_tiers(F.when(F.col("product_id") % 2 == 0, F.lit("5개: 900원")).otherwise(F.lit("")))
    tiers = F.transform(tiers, lambda t: F.struct(t["qty"].alias("qty"), t["price"].cast("double").alias("price")))
    rows = _table([F.lit("10"), F.lit("3개")], [F.col("size").cast("string"), F.lit("700원")])
    return df.select("product_id", F.explode(page.first_layout(tiers, page.transpose_tiers(rows))).alias("t")).select("product_id", "t.qty", "t.price")


_over("layout_dispatch", "messy", _layouts,
      "SELECT product_id, 5 AS qty, trunc(900.0E0 * 1.1E0) AS price FROM messy WHERE product_id % 2 = 0 UNION ALL SELECT product_id, 10, CAST(size AS DOUBLE) * 1.1E0 FROM messy WHERE product_id % 2 <> 0 UNION ALL SELECT product_id, 3, 700.0E0 * 1.1E0 FROM messy WHERE product_id % 2 <> 0")
_over("transpose_tiers", "messy",
      lambda df: df.select("product_id", F.explode(page.transpose_tiers(_table([F.lit("100 미만"), F.col("size").cast("string")], [F.col("product_id").cast("string"), F.lit("2,500원")]))).alias("t")).select("product_id", "t.qty", "t.price"),
      "SELECT product_id, 99 AS qty, CAST(product_id AS DOUBLE) * 1.1E0 AS price FROM messy UNION ALL SELECT product_id, size, 2500.0E0 * 1.1E0 FROM messy")
