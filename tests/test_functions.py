"""Cases with known results for the column functions and rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wareweave.functions import money, scores, text, urls
from wareweave.operators import joins, rules, vectors
from wareweave.sources import sheets


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, given, expected",
    [
        (text.clean_name_basic, "12-abc/(3)", "abc3"),
        (text.clean_name, "NEW cup 2024_A. 1+1 // note", "cup"),
        (text.clean_name, "정품 스텐 컵", "스텐 컵"),
        (text.search_key, "7-tea_pot/(15)", "tea pot"),
        (text.clean_name_match, "컵 [new] (red) a.b-c", "컵 a b-c"),
        (text.stock_status, "일시품절", "Out of Stock"),
        (text.stock_status, "재고 부족", "Low Stock"),
        (text.normalize_name, "Samsung, TV!", "삼성 tv"),
        (money.to_numeric, "1,234", 1234.0),
        (money.to_numeric, "#REF!", None),
        (money.clean_quantity, "10 미만", 9),
        (money.clean_quantity, "3천부", 3000),
        (urls.clean_image_url, '=IMAGE("https://a.com/x.jpg", 2)', "https://a.com/x.jpg"),
        (urls.clean_image_url, "없음", ""),
        (urls.normalize_url, "http://user@a.com/b c", "https://usera.com/b%20c"),
        (urls.clean_url, "nan", ""),
        (urls.likely_image, "https://cdn.pixabay.com/1", True),
        (urls.likely_image, "https://a.com/x.JPG", True),
        (urls.likely_image, "https://a.com/x", False),
        (urls.shown_image, "https://a.com/btn_x.png", False),
        (urls.clean_url, None, ""),
    ],
)
def test_text(spark, function, given, expected):
    assert one(spark, function(F.col("a").cast("string")), a=given) == expected


def test_numbers_keep_their_context(spark):
    got = one(spark, text.number_context(F.col("a")), a="abcdefghijklm 12 z 3")
    assert got == ["efghijklm 12 z 3", "jklm 12 z 3"]


@pytest.mark.parametrize("a, b, ratio", [("abc", "abc", 1.0), ("abc", "axc", 2 / 3), ("", "", 1.0), ("", "a", 0.0), ("kitten", "sitting", 8 / 13)])
def test_edit_ratio(spark, a, b, ratio):
    assert one(spark, scores.edit_ratio("a", "b"), a=a, b=b) == pytest.approx(ratio)


def test_edit_ratio_is_by_common_subsequence(spark):
    import random

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j], row[j + 1])
        return row[-1]

    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 12))), "".join(rng.choices("abcd", k=rng.randint(0, 12)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", scores.edit_ratio("a", "b").alias("r")).collect()
    for r in got:
        n = len(r["a"]) + len(r["b"])
        assert r["r"] == pytest.approx(2 * lcs(r["a"], r["b"]) / n if n else 1.0)


def test_tfidf_of_two_texts(spark):
    w = (1 + __import__("math").log(1.5)) ** 2
    got = one(spark, scores.tfidf_cosine(F.col("a"), F.col("b")), a="red cup", b="red pot")
    assert got == pytest.approx(1 / (1 + 2 * w))
    assert one(spark, scores.tfidf_cosine(F.col("a"), F.col("b")), a="", b="a") == 0.5


def test_spec_and_score(spark):
    assert one(spark, scores.spec_similarity(F.col("a"), F.col("b")), a="cup 500ml", b="mug 500 ML") == 1.0
    assert one(spark, scores.spec_similarity(F.col("a"), F.col("b")), a="cup 500ml", b="mug 30 ml") == 0.5
    full = scores.text_score(*[F.lit(x) for x in (0.5, 0.5, 0.5, 1.0, 0.5)])
    assert one(spark, full) == pytest.approx(0.55)


def test_weights_sum_to_one(spark):
    w = scores.adaptive_weights(F.col("t"), F.col("i"), F.lit(True))
    for t, i in [(0.95, 0.1), (0.1, 0.95), (0.5, 0.5), (0.2, 0.2)]:
        got = one(spark, w, t=t, i=i)
        assert got["w_text"] + got["w_image"] == pytest.approx(1)
    assert one(spark, scores.adaptive_weights(F.col("t"), F.col("i"), F.lit(False)), t=0.5, i=0.5)["w_text"] == 1


def test_second_stage_rules(spark):
    schema = "id int, price_2 double, diff_2 double, pct_2 double, qty_2 double, price_3 double, diff_3 double, pct_3 double, qty_3 double"
    rows = [
        (1, 90.0, -10.0, -10.0, 1.0, 80.0, -20.0, -20.0, 5.0),
        (2, 99.0, -1.0, -1.0, 1.0, None, None, None, None),
        (3, None, None, None, None, 90.0, -10.0, -10.0, None),
        (4, None, None, None, None, 95.0, -5.0, -5.0, 10.0),
        (5, 110.0, 10.0, 10.0, 1.0, 70.0, -30.0, -30.0, 1.0),
        (6, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: (r["price_2"], r["price_3"]) for r in rules.second_stage(df).collect()}
    assert got == {1: (90.0, 80.0), 4: (None, 95.0), 5: (None, 70.0)}
    assert {r["id"] for r in rules.second_stage_strict(df).collect()} == {1, 4}


def test_category_groups(spark):
    df = spark.createDataFrame([(1, "가전", "컴퓨터"), (2, "전자제품", "가전"), (3, None, "신발"), (4, "신발", "간식"), (5, " 가방", "가방")], "id int, a string, b string")
    assert {r["id"] for r in joins.category_pairs(df, "a", "b").collect()} == {1, 3, 5}


def test_price_band_keeps_unpriced_rows(spark):
    a = spark.createDataFrame([(1, 100.0), (1, 0.0)], "k int, p double")
    b = spark.createDataFrame([(1, 71.0), (1, 69.0), (1, 0.0), (1, 142.0)], "k int, q double")
    got = {(r["p"], r["q"]) for r in joins.price_band_join(a, b, "p", "q", ["k"], 0.0, 1e9).collect()}
    assert got == {(100.0, 71.0), (100.0, 0.0), (100.0, 142.0), (0.0, 71.0), (0.0, 69.0), (0.0, 0.0), (0.0, 142.0)}


def test_headers():
    found = sheets.resolve_headers(["제품명", "Price (KRW)", "sku", "image url", "memo"])
    assert found["상품명"] == "제품명" and found["판매단가(V포함)"] == "Price (KRW)" and found["상품Code"] == "sku"


def test_csv_error_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,price\ncup,#REF!\npot,12\n", encoding="utf-8")
    assert [r["price"] for r in sheets.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [None, "12"]


def test_tax_wording(spark):
    for words, loose, strict in [("VAT 포함", 100.0, 100.0), ("vat 별도", 100.0, 110.0), ("none", 110.0, 110.0)]:
        assert one(spark, money.vat_gross_up(F.lit(100.0), F.lit(words))) == pytest.approx(loose)
        assert one(spark, money.vat_gross_up(F.lit(100.0), F.lit(words), strict=True)) == pytest.approx(strict)


def test_keywords_go_in_list_order(spark):
    assert one(spark, text.clean_name(F.col("a")), a="주문제작수건 결혼답례품 수건") == ""
    assert one(spark, text.clean_name(F.col("a")), a="돌답례품수건 a") == "돌 a"


def test_best_match_is_chosen_after_the_cut(spark):
    rows = [(1, 10 + i, "s", 100.0 - i, 0.99 - i / 100) for i in range(5)] + [(1, 99, "s", 1.0, 0.80)]
    df = spark.createDataFrame(rows, "product_id int, offer_id int, seller string, offer_price double, combined double")
    assert joins.best_match(df, 5, 0.0, 0.7).first()["offer_id"] == 14  # the cheaper sixth is never seen
    assert joins.best_match(df, 5, 0.0, 0.99).first()["offer_id"] == 10  # none is above the bound: the best score


def test_blocked_joins_find_what_exact_joins_find(spark):
    import random

    rng = random.Random(1)
    names = [" ".join(rng.sample(["red", "blue", "cup", "pot", "big", "mini", "steel"], rng.randint(1, 4))) for _ in range(80)]
    sets = {n: set(n.split()) for n in names}
    exact = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    found = joins.jaccard_join(spark.createDataFrame([(n,) for n in names], "name string"), "name", 0.5).collect()
    assert {(r["a"], r["b"]) for r in found} == exact
    points = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(10)]
    points += [(100 + i, [-x if j in rng.sample(range(64), 4) else x for j, x in enumerate(v)]) for i, v in points]
    bits = {i: [x > 0 for x in v] for i, v in points}
    apart = lambda a, b: sum(x != y for x, y in zip(bits[a], bits[b], strict=True))
    exact = {(a, b) for a in bits for b in bits if a < b and apart(a, b) <= 4}
    found = joins.hash_near(spark.createDataFrame(points, "vec_id int, embedding array<double>")).collect()
    assert {(r["a"], r["b"]) for r in found} == exact


def test_parts_are_full_but_the_last(spark):
    from wareweave.operators.ordering import split_parts

    df = spark.range(700).select((F.col("id") * 1_000_003 % 2_000_000_011).alias("seq"))
    sizes = {r["part"]: r["part_size"] for r in split_parts(df, "seq").collect()}
    assert sizes == {1: 300, 2: 300, 3: 100}


@pytest.mark.parametrize("rows", [7, 1000])
def test_nearest_vectors_of_any_label(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    values = rng.normal(size=(60, 8))
    data = [(i, v.tolist(), None if i % 7 == 0 else i % 5) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "vec_id int, embedding array<double>, label int")
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    want = {(q, int(v), r) for q in range(0, 60, 10) for r, v in enumerate([v for v in np.argsort(-(unit @ unit[q])) if v != q][:3], 1)}
    found = vectors.cosine_topk(df, df.filter("vec_id % 10 = 0"), 3, 8).collect()
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found} == want
