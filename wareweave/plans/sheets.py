"""Queries of the scans, sinks and record formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareweave.operators.ordering import split_parts
from wareweave.plans.views import oracle, view
from wareweave.session import new_folder
from wareweave.sources import sheets

QUERIES: dict = {}


def _over(name: str, source: str, run, sql: str) -> None:
    QUERIES[name] = (lambda spark, sf_dir: run(view(spark, sf_dir, source)), oracle(source, sql))


def _scan(df):
    """The sheet as an older export, in CP949, read back."""
    path = new_folder(df.sparkSession)
    sheets.write_csv(df.select("product_id", "raw_price", "raw_qty"), path, "CP949")
    return sheets.read_csv(df.sparkSession, path, "product_id long, raw_price string, raw_qty string")


_over("scan_catalog", "messy", _scan, "SELECT product_id, CASE WHEN raw_price NOT IN ('#REF!', '') THEN raw_price END AS raw_price, raw_qty FROM messy")
_over("harmonize_columns", "messy",
      lambda df: sheets.harmonize(df.select("product_id", F.col("name").alias("제품명"), F.col("price").alias("Price "), F.col("raw_url").alias("상품링크"), F.col("size").alias("수량")), "product_id", "sheet")
      .select("product_id", F.col("상품명").alias("name"), F.col("판매단가(V포함)").alias("price"), F.col("상품Code").alias("code"), F.col("본사 이미지").alias("image"), F.col("본사상품링크").alias("link"), F.col("기본수량(1)").alias("qty"), F.col("제품명").alias("own_name"), "source"),
      "SELECT product_id, name, price, 'GEN-' || CAST(product_id AS STRING) AS code, '' AS image, raw_url AS link, size AS qty, name AS own_name, 'sheet' AS source FROM messy")


def _items(df):
    text = lambda c: F.col(c).cast("string")
    item = F.struct(
        F.concat(F.lit("<b>"), "name", F.lit("</b> "), "brand").alias("title"),
        text("product_id").alias("lprice"),
        F.when(F.col("product_id") % 2 == 0, text("product_id")).otherwise("").alias("productId"),
        F.concat(F.lit("http://shop.example.com/"), text("product_id")).alias("link"),
        F.col("category").alias("category1"),
        F.when(F.col("product_id") % 3 == 0, F.col("brand")).otherwise("").alias("category2"),
        F.lit("http://img.example.com/1.jpg").alias("image"),
    )
    return sheets.parse_items(df.select("product_id", F.to_json(item).alias("item_json")), "item_json")


_over("json_items", "messy", _items,
      "SELECT product_id, name || ' ' || brand AS name, product_id AS price, CASE WHEN product_id % 2 = 0 THEN CAST(product_id AS STRING) ELSE md5('http://shop.example.com/' || CAST(product_id AS STRING)) END AS id, category || CASE WHEN product_id % 3 = 0 THEN ' > ' || brand ELSE '' END AS category, 'https://img.example.com/1.jpg' AS image FROM messy")
_over("product_json_roundtrip", "messy",
      lambda df: sheets.from_record(sheets.to_record(df.select(F.col("product_id").cast("string").alias("id"), F.when(F.col("product_id") % 10 != 0, F.col("name")).alias("name"), F.lit("sheet").alias("source"), "price", F.when(F.col("product_id") % 3 == 0, "").otherwise(F.col("brand")).alias("brand"), "category"))),
      "SELECT CAST(product_id AS STRING) AS id, name, 'sheet' AS source, price, CASE WHEN product_id % 3 <> 0 THEN brand END AS brand, category FROM messy WHERE product_id % 10 <> 0")
_over("sink_roundtrip", "offers", lambda df: sheets.write_table(df.select("offer_id", "product_id", "price", "channel"), new_folder(df.sparkSession), by="channel").select("offer_id", "product_id", "price", F.col("channel").cast("string").alias("channel")),
      "SELECT offer_id, product_id, price, channel FROM offers")
_over("split_parts", "messy", lambda df: split_parts(df.select("product_id", "division"), "product_id", division="division"),
      "SELECT product_id, division, part, part_size, CASE WHEN (SELECT arg_min(division, product_id) FROM messy) = 'P' THEN '가격관리' ELSE '승인관리' END || CAST(part AS STRING) || '(' || CAST(part_size AS STRING) || ')' AS label FROM (SELECT *, count(*) OVER (PARTITION BY part) AS part_size FROM (SELECT product_id, division, CAST((row_number() OVER (ORDER BY product_id) - 1) // 300 + 1 AS BIGINT) AS part FROM messy))")


def _merged(df):
    """Parts written below one folder, one of them empty and one without the brand, read as one table."""
    folder = new_folder(df.sparkSession)
    parts = split_parts(df.select("product_id", "name", "brand"), "product_id")
    sheets.write_table(parts.filter("part % 2 = 0"), f"{folder}/even", by="part")
    sheets.write_table(parts.filter("part % 2 = 1").drop("brand"), f"{folder}/odd")
    sheets.write_table(parts.filter("part < 0"), f"{folder}/none")
    return sheets.merge_folder(df.sparkSession, folder).select("product_id", "name", "brand")


_over("merge_parts", "messy", _merged,
      "SELECT product_id, name, CASE WHEN (row_number() OVER (ORDER BY product_id) - 1) // 300 % 2 = 1 THEN brand END AS brand FROM messy")
_over("resume_at", "first_stage", lambda df: sheets.resume_at(df.select("product_id", F.when(F.col("diff_2") < 0, "l2").alias("link_2"), F.when(F.col("diff_3") < 0, "l3").alias("link_3")), "product_id", ("link_2", "link_3")),
      "SELECT min(product_id) AS product_id FROM first_stage WHERE NOT coalesce(diff_2 < 0, false) AND NOT coalesce(diff_3 < 0, false) HAVING count(*) > 0")
_over("resume_pending", "first_stage", lambda df: sheets.pending(df.select("product_id", "name"), df.filter((F.col("diff_2") < 0) & (F.col("diff_3") < 0)), "product_id"),
      "SELECT product_id, name FROM first_stage WHERE NOT coalesce(diff_2 < 0 AND diff_3 < 0, false)")
_over("limit_preview", "messy", lambda df: df.select("product_id", "name", "price").orderBy("product_id").limit(10), "SELECT product_id, name, price FROM messy ORDER BY product_id LIMIT 10")


def _encodings(df):
    """A folder with sheets in UTF-8 and in CP949, each read in its own encoding; rows that do not fit are kept as text."""
    path = new_folder(df.sparkSession)
    rows = df.select(F.when(F.col("product_id") % 10 == 9, F.lit("x")).otherwise(F.col("product_id").cast("string")).alias("product_id"), "raw_price", "raw_qty")
    sheets.write_csv(rows.filter(df["product_id"] % 2 == 0), f"{path}/new")
    sheets.write_csv(rows.filter(df["product_id"] % 2 == 1), f"{path}/old", "CP949")
    found = sheets.read_csv(df.sparkSession, f"{path}/*", "product_id long, raw_price string, raw_qty string", corrupt="unread")
    return found.select("product_id", "raw_price", "raw_qty", F.col("unread").isNotNull().alias("unread"))


_over("scan_encodings", "messy", _encodings,
      """SELECT CASE WHEN product_id % 10 <> 9 THEN product_id END AS product_id, CASE WHEN raw_price NOT IN ('#REF!', '') THEN raw_price END AS raw_price, raw_qty,
      product_id % 10 = 9 AS unread FROM messy""")  # fmt: skip


def _sheets(df):
    """Three sheets of other headers, types and columns as one table."""
    part = lambda k, *columns: df.filter(F.col("product_id") % 3 == k).select("product_id", *columns)
    three = {
        "spring": part(0, F.col("name").alias("제품명"), F.col("price").alias("가격"), F.col("size").alias("수량")),
        "summer": part(1, F.col("name").alias("품명 (EA) "), F.col("size").alias("PRICE"), F.col("brand").alias("memo")),
        "autumn": part(2, F.col("name").alias("상품명"), F.col("raw_code").alias("sku"), F.col("raw_url").alias("product URL"), F.col("size").alias("Memo")),
    }
    found = sheets.harmonize_sheets(three, "product_id")
    return found.select("product_id", "source", F.col("상품명").alias("name"), F.col("판매단가(V포함)").alias("price"), F.col("상품Code").alias("code"), F.col("본사상품링크").alias("link"), "memo")


_over("harmonize_sheets", "messy", _sheets,
      """SELECT product_id, ['spring', 'summer', 'autumn'][1 + product_id % 3] AS source, name, CASE product_id % 3 WHEN 0 THEN price WHEN 1 THEN CAST(size AS DOUBLE) ELSE 0.0E0 END AS price,
      CASE WHEN product_id % 3 = 2 THEN raw_code ELSE 'GEN-' || CAST(product_id AS STRING) END AS code, CASE WHEN product_id % 3 = 2 THEN raw_url ELSE '' END AS link,
      CASE product_id % 3 WHEN 1 THEN brand WHEN 2 THEN CAST(size AS STRING) END AS memo FROM messy""")  # fmt: skip


def _part_files(df):
    """Parts written as files and counted from the files."""
    path = new_folder(df.sparkSession)
    parts = split_parts(df.select("product_id", "name", "division"), "product_id", division="division")
    sheets.write_parts(parts.select("product_id", "name", "part", "label"), path, "label", "product_id")
    return sheets.list_parts(df.sparkSession, path, "label", "product_id long, name string, part long")


_over("part_files", "messy", _part_files,
      """SELECT CASE WHEN (SELECT arg_min(division, product_id) FROM messy) = 'P' THEN '가격관리' ELSE '승인관리' END || CAST(part AS STRING) || '(' || CAST(count(*) AS STRING) || ')' AS label, 1 AS files, count(*) AS rows
      FROM (SELECT (row_number() OVER (ORDER BY product_id) - 1) // 300 + 1 AS part FROM messy) GROUP BY part""")  # fmt: skip


def _runs(df):
    """Two runs: the first broke off half-way and is run again, the second is sent twice."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    rows = df.select("product_id", "name", "price_2")
    first, second, third = (rows.filter(F.col("product_id") % 3 == k) for k in range(3))
    broken = first.filter(F.col("product_id") % 2 == 0).withColumn(sheets.RUN, F.lit("a"))
    broken.write.partitionBy(sheets.RUN).parquet(f"{path}/rows")  # no row in the done-log
    for run_id, part in (("a", first), ("b", second), ("b", second)):
        sheets.append_run(part, path, run_id)
    third.withColumn(sheets.RUN, F.lit("c")).write.mode("append").partitionBy(sheets.RUN).parquet(f"{path}/rows")  # breaks off for good
    return sheets.read_runs(spark, path, rows.schema)


_over("append_runs", "first_stage", _runs, "SELECT product_id, name, price_2, CASE product_id % 3 WHEN 0 THEN 'a' ELSE 'b' END AS run_id FROM first_stage WHERE product_id % 3 < 2")


def _tier_files(df):
    path = new_folder(df.sparkSession)
    tiers = df.groupBy("channel", "qty").agg(F.min("price").alias("unit_price"))
    sheets.write_tiers(tiers, path, "channel")
    return sheets.read_tiers(df.sparkSession, path, "channel")


_over("tier_files", "offers", _tier_files, "SELECT channel, qty, min(price) AS unit_price FROM offers GROUP BY channel, qty")
