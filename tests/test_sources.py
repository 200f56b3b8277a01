"""Sheets in several encodings, part files, runs that break off, and price tables as files."""

import pytest
from pyspark.sql import functions as F

from wareweave.operators import ordering, rules
from wareweave.operators.summaries import full_price_map
from wareweave.sources import sheets


def put(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))


def test_every_file_in_its_own_encoding(spark, tmp_path):
    put(tmp_path / "in", "new sheet.csv", "id,가격\n1,가격 표\n2,#REF!\n")
    put(tmp_path / "in", "old sheet%1.csv", "id,가격\n3,똠방각하\n4,구형\n", "cp949")
    got = sheets.read_csv(spark, str(tmp_path / "in")).collect()
    assert sorted(map(tuple, got)) == [("1", "가격 표"), ("2", None), ("3", "똠방각하"), ("4", "구형")]
    assert len(sheets.files_not_utf8(spark, str(tmp_path / "in"))) == 1


def test_files_of_other_columns_and_rows_that_do_not_fit(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "id,t\n1,가\nx,나\n")
    put(tmp_path / "in", "b.csv", "id,t\n2,다\ny,라\n", "cp949")
    got = sheets.read_csv(spark, str(tmp_path / "in"), "id long, t string", corrupt="bad").collect()
    assert sorted((r["id"] or 0, r["t"], r["bad"]) for r in got) == [(0, "나", "x,나"), (0, "라", "y,라"), (1, "가", None), (2, "다", None)]
    with pytest.raises(ValueError, match="schema"):
        sheets.read_csv(spark, str(tmp_path / "in"), corrupt="bad")


def test_sheets_of_other_types_become_one(spark):
    a = spark.createDataFrame([(1, "cup", 5)], "id int, `제품명` string, `가격` int")
    b = spark.createDataFrame([(2, "pot", 2.5, "x")], "id long, `상품명 ` string, `Price` double, Note string")
    c = spark.createDataFrame([("3", 7)], "id string, note int")
    got = {r["id"]: r for r in sheets.harmonize_sheets({"a": a, "b": b, "c": c}, "id").collect()}
    assert {k: (r["상품명"], r["판매단가(V포함)"], r["source"], r["Note"]) for k, r in got.items()} == {
        "1": ("cup", 5.0, "a", None), "2": ("pot", 2.5, "b", "x"), "3": ("", 0.0, "c", "7")
    }


def test_part_files_hold_their_rows_in_order(spark, tmp_path):
    df = spark.range(701).select((F.col("id") * 7919 % 701).alias("seq"), F.lit("A").alias("kind"))
    parts = ordering.split_parts(df, "seq", division="kind")
    sheets.write_parts(parts, str(tmp_path / "out"), "label", "seq")
    listed = sheets.list_parts(spark, str(tmp_path / "out"), "label", "seq long, kind string, part long, part_size long").collect()
    assert sorted(map(tuple, listed)) == [("승인관리1(300)", 1, 300), ("승인관리2(300)", 1, 300), ("승인관리3(101)", 1, 101)]
    for folder in (tmp_path / "out").glob("label=*"):
        (name,) = folder.glob("part-*.csv")
        rows = [int(line.split(",")[0]) for line in name.read_text().splitlines()[1:]]
        assert rows == sorted(rows) and str(len(rows)) in folder.name


def test_numbers_are_cut_by_size_and_split_ties(spark):
    df = spark.range(1000).select(F.lit(5).alias("seq"), (F.col("id") % 10).alias("x"))
    df = df.unionByName(spark.createDataFrame([(None, 1), (9, 1)], "seq int, x long"))
    got = ordering.numbered(df, "seq", rows=100)
    assert sorted(r["i"] for r in got.collect()) == list(range(1, 1003))
    assert got.filter("seq IS NULL").first()["i"] == 1 and got.filter("seq = 9").first()["i"] == 1002
    assert got.filter("seq = 5").select(F.spark_partition_id()).distinct().count() > 3


def test_a_run_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (2, "b")], [(3, "c")]))
    assert sheets.append_run(a, path, "1") and sheets.append_run(b, path, "2")
    assert not sheets.append_run(b.withColumn("v", F.lit("other")), path, "2")
    read = lambda: sorted(map(tuple, sheets.read_runs(spark, path, a.schema).collect()))
    want = [(1, "a", "1"), (2, "b", "1"), (3, "c", "2")]
    assert read() == want
    # a run that breaks off after its rows does not count; run again, it replaces what it left
    a.withColumn(sheets.RUN, F.lit("3")).write.mode("append").partitionBy(sheets.RUN).parquet(f"{path}/rows")
    assert read() == want
    assert sheets.append_run(b, path, "3") and read() == [*want, (3, "c", "3")]


def test_a_run_that_fails_leaves_no_trace(spark, tmp_path):
    path = str(tmp_path / "runs")
    good = spark.createDataFrame([(1, "a")], "k int, v string")
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).cast("int").alias("k"), F.lit("a").alias("v"))
    assert sheets.append_run(good, path, "1")
    with pytest.raises(Exception, match="broken"):
        sheets.append_run(bad, path, "2")
    assert [tuple(r) for r in sheets.read_runs(spark, path, good.schema).collect()] == [(1, "a", "1")]
    assert sheets.append_run(good, path, "2")
    assert sheets.read_runs(spark, path, good.schema).count() == 2


def test_price_tables_as_files(spark, tmp_path):
    tiers = spark.createDataFrame([("c2", 10, 5.5), ("c2", 1, 9.0), ("c3", 3, 1.0)], "channel string, qty int, unit_price double")
    sheets.write_tiers(tiers, str(tmp_path / "t"), "channel")
    assert sorted(map(tuple, sheets.read_tiers(spark, str(tmp_path / "t"), "channel").collect())) == sorted(map(tuple, tiers.collect()))
    (name,) = (tmp_path / "t" / "channel=c2").glob("*.csv")
    assert name.read_text().splitlines() == ["수량,일반", "1,9.0", "10,5.5"]


def test_products_without_tiers(spark):
    tiers = spark.createDataFrame([(1, 5, 2.0, 1), (1, 5, 3.0, 2)], "p int, qty int, unit_price double, o int")
    products = spark.createDataFrame([(1, 9.0), (2, 7.0), (3, 0.0), (4, None)], "p int, price double")
    got = {r["p"]: r["tiers"] for r in full_price_map(tiers, products, "p", "price", ["o"]).collect()}
    assert got == {1: {5: 3.0}, 2: {1: 7.0}, 3: {}, 4: {}}


def test_upload_sheet_keeps_its_order(spark):
    df = spark.createDataFrame([('=IMAGE("https://a/b.jpg", 2)', "x", 3), ("None", "y", 4), (None, "z", 5)], "`네이버 이미지` string, `상품명` string, other int")
    got = rules.upload_sheet(df)
    assert got.columns == ["상품명", "네이버쇼핑(이미지링크)"]
    assert [tuple(r) for r in got.collect()] == [("x", "https://a/b.jpg"), ("y", ""), ("z", "")]


def test_a_part_whose_rows_lie_apart_is_one_file(spark, tmp_path, monkeypatch):
    """Parts that lie across two ranges of the numbering: the exchange by part stays after the join by part."""
    numbered = ordering.numbered
    monkeypatch.setattr(ordering, "numbered", lambda df, seq: numbered(df, seq, 700))
    rows = spark.range(3000).select(F.col("id").alias("product_id"), F.lit("P").alias("division"))
    parts = ordering.split_parts(rows, "product_id", division="division")
    sheets.write_parts(parts.select("product_id", "part", "label"), str(tmp_path / "parts"), "label", "product_id")
    got = sheets.list_parts(spark, str(tmp_path / "parts"), "label", "product_id long, part long").collect()
    assert sorted((r["files"], r["rows"]) for r in got) == [(1, 300)] * 10
