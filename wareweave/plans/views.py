"""The canonical inputs, bound to the driver's tables.

Each view is one SQL text that Spark and the DuckDB oracles both run: in Spark the
table names in braces are DataFrames, for an oracle they are the table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wareweave.session import table

TABLES = ("part", "lineitem", "supplier", "events", "pages", "documents", "embeddings", "orders")
CATALOG = """
SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
       p_retailprice AS price, p_size AS size FROM {part}
"""
OFFERS = """
SELECT l_orderkey * 10 + l_linenumber AS offer_id, l_partkey AS product_id,
       CASE WHEN l_suppkey % 2 = 0 THEN 'c2' ELSE 'c3' END AS channel,
       l_extendedprice / l_quantity AS price, CAST(l_quantity AS INT) AS qty,
       s_name AS seller, l_linestatus AS stock, l_suppkey AS supplier_id, l_returnflag AS flag
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
"""
#: Sheet-like rows with the faults that the cleaning rules are about.
MESSY = """
SELECT p_partkey AS product_id,
  CAST(p_partkey % 13 AS STRING) || '-' || p_name || CASE p_partkey % 5
    WHEN 0 THEN ' (12) // sample' WHEN 1 THEN '/' || p_brand WHEN 2 THEN ' [new] 2024_A. 1+1' WHEN 3 THEN '_NEW (x y)' ELSE '  500ml 정품' END AS raw_name,
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'AB-' || CAST(p_partkey AS STRING) WHEN 2 THEN 'x#' || CAST(p_partkey AS STRING) || '!'
    WHEN 3 THEN '  ' WHEN 4 THEN '##' ELSE CAST(NULL AS STRING) END AS raw_code,
  CASE p_partkey % 8 WHEN 0 THEN '#REF!' WHEN 1 THEN '-' WHEN 2 THEN '1,' || CAST(100 + p_partkey % 900 AS STRING) WHEN 3 THEN CAST(NULL AS STRING)
    WHEN 4 THEN CAST(p_partkey * 10 AS STRING) || '원' WHEN 5 THEN '' WHEN 6 THEN '동일상품 없음' ELSE CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.5.1' ELSE '.5' END END AS raw_price,
  CASE p_partkey % 7 WHEN 0 THEN 'www.example.com/p/' || CAST(p_partkey AS STRING) WHEN 1 THEN 'http://user@example.com/a b.jpg' WHEN 2 THEN ''
    WHEN 3 THEN '//img.example.com/' || CAST(p_partkey AS STRING) || '.png' WHEN 4 THEN '=IMAGE("https://img.example.com/' || CAST(p_partkey AS STRING) || '.jpg", 2)'
    WHEN 5 THEN 'https://example.com/i?no=' || CAST(p_partkey AS STRING) || '#top' ELSE 'none' END AS raw_url,
  CASE p_partkey % 4 WHEN 0 THEN '품절' WHEN 1 THEN 'temporarily out today' WHEN 2 THEN '재고 부족' ELSE 'ok' END AS raw_stock,
  CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'P' ELSE '?' END AS division,
  CASE p_partkey % 4 WHEN 0 THEN '10 미만' WHEN 1 THEN '3천부' WHEN 2 THEN '50개' ELSE '없음' END AS raw_qty,
  CASE p_partkey % 3 WHEN 0 THEN p_name || ' 기념품' WHEN 1 THEN p_name || ' vat 포함' ELSE p_name END AS title,
  p_name AS name, p_type AS category, p_brand AS brand, p_retailprice AS price, p_size AS size
FROM {part}
"""
#: Cheapest offer of each channel beside its product: the first-stage table.
FIRST_STAGE = """
WITH o AS (""" + OFFERS + """), r AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, channel ORDER BY price, qty, offer_id, seller) AS rn FROM o WHERE price IS NOT NULL
), b AS (
  SELECT product_id, MAX(CASE WHEN channel = 'c2' THEN price END) AS price_2, MAX(CASE WHEN channel = 'c2' THEN qty END) AS qty_2, MAX(CASE WHEN channel = 'c2' THEN seller END) AS seller_2,
    MAX(CASE WHEN channel = 'c3' THEN price END) AS price_3, MAX(CASE WHEN channel = 'c3' THEN qty END) AS qty_3, MAX(CASE WHEN channel = 'c3' THEN seller END) AS seller_3
  FROM r WHERE rn = 1 GROUP BY product_id
)
SELECT p.p_partkey AS product_id, p.p_name AS name, p.p_retailprice AS price,
  price_2, price_2 - p_retailprice AS diff_2, (price_2 - p_retailprice) / nullif(p_retailprice, 0) * 100 AS pct_2, CAST(qty_2 AS DOUBLE) AS qty_2, seller_2,
  price_3, price_3 - p_retailprice AS diff_3, (price_3 - p_retailprice) / nullif(p_retailprice, 0) * 100 AS pct_3,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(qty_3 AS DOUBLE) END AS qty_3, seller_3
FROM {part} p LEFT JOIN b ON p.p_partkey = b.product_id
"""
#: Scored pairs of products and their offers: scores come from keys, so both engines agree.
PAIRS = """
WITH o AS (""" + OFFERS + """)
SELECT o.product_id, o.channel, o.offer_id, o.seller, o.price AS offer_price, p.p_retailprice AS price,
       (o.offer_id * 7 + o.product_id) % 101 / 100.0E0 AS text_sim, (o.offer_id * 13 + o.product_id) % 97 / 96.0E0 AS image_sim,
       o.offer_id % 4 <> 0 AS has_images, o.qty, o.stock
FROM o JOIN {part} p ON o.product_id = p.p_partkey
"""
VIEWS = {"catalog": CATALOG, "offers": OFFERS, "messy": MESSY, "first_stage": FIRST_STAGE, "pairs": PAIRS}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def oracle(name: str, select: str) -> str:
    """An oracle over one view."""
    return f"WITH {name} AS ({VIEWS[name].format(**{t: t for t in TABLES})}) {select}"
