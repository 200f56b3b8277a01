"""Edges of the rules, with results worked out by hand, and the match path against plain Python."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.test_functions import one
from wareweave.functions import money, pages, scores, text, urls
from wareweave.operators import joins, ordering, rules
from wareweave.plans import matching, registry
from wareweave.plans.views import view
from wareweave.sources import sheets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("given, want", [("1.2.3", 0.0), (".", 0.0), (None, 0.0), ("none", 100.0), ("50원", 100.0), ("1,234.5", 1234.5), ("9" * 12, 10000.0)])
def test_clean_price(spark, given, want):
    assert one(spark, money.clean_price(F.col("a").cast("string"), 100.0, 10000.0), a=given) == want


@pytest.mark.parametrize("given, want", [("VAT 포함 3개: 333원", [(3, 333)]), ("5개: 1,001원 3개: 333원", [(3, 366), (5, 1101)]), ("none", [])])
def test_tiers_with_and_without_tax(spark, given, want):
    assert [tuple(t) for t in one(spark, pages.priced_tiers(F.col("a")), a=given)] == want


def test_tier_tables_and_spec_maps(spark):
    rows = F.array(*[F.array(*map(F.lit, r)) for r in (["회원", "1", "2"], ["수량", "100 미만", "50개"], ["일반", "1,000원", "x"])])
    assert [tuple(t) for t in one(spark, pages.transpose_tiers(rows))] == [(99, pytest.approx(1100.0))]
    html = "<th>a</th><td>1</td><th>b</th><td>2</td><th>a</th><td>3</td><td>4</td>"
    assert one(spark, pages.spec_map(F.col("h")), h=html) == {"b": "2", "a": "3"}


def test_page_images_and_flags(spark):
    html = """<img alt="x" src="/a.jpg"><img src='/btn_1.png'><p style="background:url('/b.webp?x=1')"><img src="/a.jpg"><img src="/c.txt">"""
    assert one(spark, pages.image_links(F.col("h")), h=html) == ["/a.jpg", "/b.webp?x=1"]
    flags = pages.page_flags(F.col("h"))
    got = spark.range(1).select(F.lit("Sold Out. VAT 별도. 상품코드: AB-12").alias("h")).select(*(c.alias(n) for n, c in flags.items())).first()
    assert (got["sold_out"], got["vat_named"], got["code"]) == (True, True, "AB-12")


def test_urls(spark):
    assert one(spark, urls.clean_image_url(F.col("a")), a="HTTP://a.com/x.jpg") == "HTTP://a.com/x.jpg"
    assert one(spark, urls.url_id(F.col("a"), "no"), a="https://a.com/?no=12&x") == "12"
    assert len(one(spark, urls.url_id(F.col("a"), "no"), a="https://a.com/?no=x")) == 32
    assert one(spark, urls.shop_ui_image(F.col("a")), a="https://a.com/common/x.jpg")
    for given, want in [("", "https://h.com/shop_7_0.jpg"), ("/x.jpg", "https://h.com/x.jpg"), ("//c.com/x", "https://c.com/x"), ("x.jpg", "https://h.com/x.jpg"), ("HTTPS://c.com/x", "HTTPS://c.com/x")]:
        assert one(spark, urls.repair_image(F.col("a"), "https://h.com", F.lit(7)), a=given) == want
    assert one(spark, urls.pick_status(F.array(F.lit("a.PNG")))) == "Image Not Found"


def test_numbers_with_context_in_long_texts(spark):
    import re

    given = "a1b22\nc 333 " * 2000
    want = [given[max(m.start() - 10, 0) : m.end() + 10] for m in re.finditer(r"\d+", given)]
    assert one(spark, text.number_context(F.col("a")), a=given) == want


def test_first_stage_takes_one_offer_and_survives_zero_prices(spark):
    catalog = spark.createDataFrame([(1, "a", 100.0), (2, "b", 0.0), (3, "c", None)], "product_id int, name string, price double")
    offers = spark.createDataFrame(
        [(10, 1, "c2", 90.0, 50, "s"), (11, 1, "c2", 95.0, 1, "t"), (12, 1, "c3", None, 1, "u"), (13, 2, "c2", 5.0, 2, "v"), (14, 2, "c2", 5.0, 1, "w")],
        "offer_id int, product_id int, channel string, price double, qty int, seller string",
    )
    got = {r["product_id"]: r for r in joins.first_stage(catalog, offers).collect()}
    assert (got[1]["price_2"], got[1]["qty_2"], got[1]["seller_2"], got[1]["pct_2"], got[1]["price_3"]) == (90.0, 50.0, "s", -10.0, None)
    assert (got[2]["price_2"], got[2]["qty_2"], got[2]["pct_2"]) == (5.0, 1.0, None)
    assert got[3]["price_2"] is None


def test_first_stage_rows_exist_in_offers(spark):
    offers = {(r["product_id"], r["price"], float(r["qty"]), r["seller"]) for r in view(spark, SF, "offers").collect()}
    for r in joins.first_stage(view(spark, SF, "catalog"), view(spark, SF, "offers")).collect():
        for n in ("2", "3"):
            assert r[f"price_{n}"] is None or (r["product_id"], r[f"price_{n}"], r[f"qty_{n}"], r[f"seller_{n}"]) in offers


def test_reference_price(spark):
    df = spark.createDataFrame([(None, 5.0), (0.0, 5.0), (100.0, 99.0), (100.0, 105.0), (100.0, 110.0), (100.0, 0.0), (None, None)], "p double, c double")
    assert [tuple(r) for r in rules.reference_price(df, "p", "c").collect()] == [(None, 5.0), (0.0, 5.0), (100.0, 99.0), (100.0, 110.0)]


def test_price_band_takes_missing_prices_as_zero(spark):
    a = spark.createDataFrame([(1, None), (1, 100.0)], "k int, p double")
    b = spark.createDataFrame([(1, None), (1, 50.0)], "k int, q double")
    got = {(r["p"], r["q"]) for r in joins.price_band_join(a, b, "p", "q", ["k"], 0.0, 1e9).collect()}
    assert got == {(None, None), (None, 50.0), (100.0, None)}


def test_second_stage_cells(spark):
    schema = "id int, price_2 double, diff_2 double, pct_2 double, qty_2 string, seller_2 string, price_3 double, diff_3 double, pct_3 double, qty_3 double, seller_3 string"
    rows = [
        (1, 90.0, -10.0, -10.0, "품절", "s", None, None, None, None, None),
        (2, 99.5, -0.5, -0.5, "1", "s", 95.0, -5.0, -5.0, None, "기프트샵"),
        (3, 99.5, -0.5, -0.5, "1", "s", 95.0, -5.0, -5.0, None, "shop"),
        (4, None, None, None, None, None, 95.0, -5.0, -5.0, 3.0, "shop"),
        (5, 110.0, 10.0, 10.0, "1", "s", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: (r["price_2"], r["qty_2"], r["seller_2"], r["seller_3"]) for r in rules.second_stage_cells(df, text.contains_any(F.col("seller_3"), text.FILTER_WORDS)).collect()}
    assert got == {1: (90.0, None, "s", None), 2: (None, None, None, "기프트샵"), 4: (None, None, None, "shop")}


def test_percent_of_channels_is_rounded(spark):
    got = registry.queries()["cross_channel_diff"](spark, SF).filter("pct_of_c3 IS NOT NULL").first()
    assert got["pct_of_c3"] == round(got["pct_of_c3"], 2)


def test_headers_keep_the_sheet():
    found = sheets.resolve_headers(["item no", "상품 이름2", "수량"])
    assert found["상품명"] == "상품 이름2"  # the alternatives' order decides, not the columns'
    assert sheets.resolve_headers(["item no", "x 제품"])["상품명"] == "item no"
    assert found["기본수량(1)"] == "수량"


def test_harmonize_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "cup", "memo", 5)], "id int, `제품명` string, note string, `수량` int")
    got = sheets.harmonize(df, "id", "sheet").first()
    assert (got["상품명"], got["note"], got["기본수량(1)"], got["판매단가(V포함)"], got["상품Code"], got["source"]) == ("cup", "memo", 5, 0.0, "GEN-1", "sheet")


def test_parts_of_sparse_keys_and_their_labels(spark):
    df = spark.range(700).select((F.col("id") * 1_000_003 % 2_000_000_011 * 10**6).alias("seq"), F.when(F.col("id") == 0, "p").otherwise("A").alias("kind"))
    parts = ordering.split_parts(df, "seq", division="kind")
    assert {r["label"] for r in parts.select("label").distinct().collect()} == {"가격관리1(300)", "가격관리2(300)", "가격관리3(100)"}
    i = {r["seq"]: r["i"] for r in ordering.numbered(df, "seq").collect()}
    assert [i[s] for s in sorted(i)] == list(range(1, 701))
    assert ordering.numbered(df.filter("seq < 0"), "seq").count() == 0


def test_pages_are_cut_before_the_filter(spark):
    df = spark.createDataFrame([(1, k, float(k), "s", k % 2) for k in range(10)], "product_id int, offer_id int, offer_price double, seller string, odd int")
    assert [r["offer_id"] for r in joins.cheapest(df, 2, F.col("odd") == 1, page=2, pages=2).orderBy("rank").collect()] == [1, 3]
    assert [r["offer_id"] for r in joins.cheapest(df, 9, F.col("odd") == 1, page=2, pages=2).orderBy("rank").collect()] == [1, 3]


def test_resume_at_the_first_row_without_links(spark):
    df = spark.createDataFrame([(3, None, None), (1, "x", None), (2, None, None)], "i int, a string, b string")
    assert [r["i"] for r in sheets.resume_at(df, "i", ("a", "b")).collect()] == [2]
    assert sheets.resume_at(df.filter("i = 1"), "i", ("a", "b")).count() == 0


def test_best_pairs_of_names(spark):
    df = spark.createDataFrame([("a b c",), ("a b d",), ("a b c d",), ("x y",)], "name string")
    got = [(r["a"], r["b"], r["rank"]) for r in joins.jaccard_join(df, "name", 0.4, 1).collect()]
    assert sorted(got) == [("a b c", "a b c d", 1), ("a b c d", "a b d", 1)]


def test_match_path_by_plain_python(spark):
    products = {r["product_id"]: r for r in view(spark, SF, "catalog").collect()}
    offers = view(spark, SF, "offers").withColumnRenamed("price", "offer_price").collect()
    tail = lambda o, p: (" 홍보", f" {p['name']}")[o["offer_id"] % 7] if o["offer_id"] % 7 < 2 else " [x] (y)"
    title = lambda o, p: (p["name"], f"new {p['name']} 500ml", f"{p['brand']} {p['name']}", p["category"] + tail(o, p))[o["offer_id"] % 4]
    shelf = lambda o, p: (None, "Standard ", p["category"].lower(), p["category"], p["category"])[o["offer_id"] % 5]
    groups_of = matching._GROUPS.values()

    def together(x, y):
        x, y = (x or "").strip().lower(), (y or "").strip().lower()
        return not x or not y or x == y or any(x in g and y in g for g in groups_of)

    pairs = sorted({(p["name"], title(o, p)) for o in offers for p in [products[o["product_id"]]]})
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.withColumns({f"n{x}": text.normalize_name(text.clean_name_match(F.col(x))) for x in "ab"})
    parts = df.select("a", "b", scores.edit_ratio("na", "nb").alias("e"), scores.tfidf_cosine(F.col("na"), F.col("nb")).alias("t")).collect()
    sim = {(r["a"], r["b"]): 0.3 * r["e"] + 0.7 * r["t"] for r in parts}

    def weights(t, i, images):
        if not images:
            return 1.0, 0.0
        wt, wi = (0.84, 0.24) if t > 0.9 else (0.56, 0.36) if t < 0.3 else (0.7, 0.3)
        wt, wi = (wt * 0.8, wi * 1.2) if i > 0.9 else (wt * 1.2, wi * 0.8) if i < 0.3 else (wt, wi)
        wt, wi = max(wt, 0.3), max(wi, 0.2)
        return wt / (wt + wi), wi / (wt + wi)

    groups = defaultdict(list)
    for o in offers:
        p = products[o["product_id"]]
        a, b = p["price"] or 0, o["offer_price"] or 0
        if a > 0 and b > 0 and abs(a - b) / max(a, b) > 0.3:
            continue
        if o["offer_id"] == p["product_id"] or not together(p["category"], shelf(o, p)) or "홍보" in title(o, p):
            continue
        images = o["offer_id"] % 3 > 0
        t, i = sim[p["name"], title(o, p)], o["offer_id"] % 97 / 96 if images else 0.0
        if t < 0.3 or images and i < 0.1:
            continue
        wt, wi = weights(t, i, images)
        combined = round(t * wt + i * wi, 9)
        if combined >= 0.3:
            groups[o["product_id"], o["channel"]].append((-combined, o["offer_id"], b, o["seller"]))
    want = {}
    for key, found in groups.items():
        top = sorted(found)[:5]
        sure = [x for x in top if -x[0] > 0.75]
        want[key] = min(sure, key=lambda x: (x[2], x[0], x[1])) if sure else top[0]
    got = {(r["product_id"], r["channel"]): r for r in matching.matched(spark, SF).collect()}
    assert set(got) == set(want) and len(got) > 50
    for key, r in got.items():
        assert r["combined"] == pytest.approx(-want[key][0], abs=1e-6) and math.isclose(r["offer_price"], want[key][2])


@pytest.mark.parametrize(
    ("change", "found"),
    [
        ({}, True),
        ({"offer_category": "food"}, False),  # another category
        ({"offer_category": None}, True),
        ({"title": "blue steel pot"}, False),  # text below its least
        ({"image_sim": 0.74}, False),  # image below its least
        ({"image_sim": 0.75}, True),
        ({"image_sim": None}, True),
        ({"offer_id": 1}, False),  # the product itself
        ({"title": "red cup 기념품"}, False),  # a filter word
        ({"title": "[new] red (big) cup"}, True),  # cleaned away
        ({"title": "--- ///"}, False),  # nothing left of the name
        ({"offer_price": 131.0}, True),
        ({"offer_price": 150.0}, False),
        ({"offer_price": None}, True),
    ],
)
def test_match_path_rules(spark, change, found):
    base = {"product_id": 1, "offer_id": 7, "channel": "c2", "seller": "s", "title": "Red cup", "offer_category": " Kitchen", "offer_price": 100.0, "image_sim": 0.9} | change
    schema = "product_id long, offer_id long, channel string, seller string, title string, offer_category string, offer_price double, image_sim double"
    products = spark.createDataFrame([(1, "red cup", "kitchen", 100.0)], "product_id long, name string, category string, price double")
    candidates = spark.createDataFrame([tuple(base[c.split()[0]] for c in schema.split(", "))], schema)
    assert joins.match_path(products, candidates, scores.edit_ratio, drop_filter_words=True).count() == found


def test_names_without_words_score_nothing(spark):
    df = spark.createDataFrame([("---", "///"), ("", "cup"), (None, "cup"), ("cup", "cup")], "a string, b string")
    got = [r["s"] for r in scores.score_names(df, "a", "b", scores.edit_ratio, "s").collect()]
    assert got == [0.0, 0.0, 0.0, pytest.approx(1.0)]


def test_exchanges_of_headline_queries(spark):
    count = lambda name: registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count("first_stage") <= 3 and count("lowest_offer") <= 3 and count("price_summary") <= 4
    assert count("topk_matches") <= 4
