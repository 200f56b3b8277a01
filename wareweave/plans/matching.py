"""Queries of the joins, scores and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from wareweave.functions import scores
from wareweave.functions.urls import url_id
from wareweave.operators import joins, rules
from wareweave.operators import vectors as nearest
from wareweave.operators.tiles import merged, small
from wareweave.plans.views import oracle, view
from wareweave.session import checkpoint, table

QUERIES: dict = {}
_TEXT = "text_sim * 0.7E0 + image_sim * 0.3E0"


def _over(name: str, source: str, run, sql: str | None) -> None:
    QUERIES[name] = (lambda spark, sf_dir: run(view(spark, sf_dir, source)), oracle(source, sql) if sql else None)


def _two(name: str, a: str, b: str, run, sql: str) -> None:
    """A query of two views; the oracle names both."""
    both = oracle(a, "").strip() + f", {oracle(b, '').strip().removeprefix('WITH ')} {sql}"
    QUERIES[name] = (lambda spark, sf_dir: run(view(spark, sf_dir, a), view(spark, sf_dir, b)), both)


def _combined(df):
    return df.withColumn("combined", F.expr(_TEXT))


def _neighbours(df):
    """Each product beside the one with the next id."""
    b = df.select((F.col("product_id") - 1).alias("product_id"), F.col("name").alias("name_b"), F.col("raw_name").alias("raw_b"), F.col("category").alias("category_b"))
    return df.select("product_id", "name", "raw_name", "category").join(merged(b), "product_id")


_NEXT = "SELECT a.product_id, a.name, a.raw_name, a.category, b.name AS name_b, b.raw_name AS raw_b, b.category AS category_b FROM messy a JOIN messy b ON b.product_id = a.product_id + 1"
_GROUPS = {"basic": ("economy", "standard"), "sized": ("small", "medium", "large")}

_two("pair_candidates", "catalog", "offers", lambda c, o: c.select("product_id", "name").join(o.select("product_id", "offer_id", "supplier_id"), "product_id").filter("supplier_id <> product_id"),
     "SELECT c.product_id, c.name, o.offer_id, o.supplier_id FROM catalog c JOIN offers o ON o.product_id = c.product_id WHERE o.supplier_id <> c.product_id")
_two("price_band_join", "catalog", "offers",
     lambda c, o: joins.price_band_join(c.select("product_id", "price"), o.select("product_id", "offer_id", F.col("price").alias("offer_price")), "price", "offer_price", ["product_id"], 0.0, 1e9),
     "SELECT c.product_id, c.price, o.offer_id, o.price AS offer_price FROM catalog c JOIN offers o ON o.product_id = c.product_id WHERE coalesce(c.price, 0) <= 0 OR coalesce(o.price, 0) <= 0 OR abs(c.price - o.price) / greatest(c.price, o.price) <= 0.3E0")
_over("category_compat_join", "messy", lambda df: joins.category_pairs(_neighbours(df), "category", "category_b", _GROUPS).select("product_id", "category", "category_b"),
      f"SELECT product_id, category, category_b FROM ({_NEXT}) WHERE category = category_b OR (lower(category) IN {_GROUPS['basic']} AND lower(category_b) IN {_GROUPS['basic']}) OR (lower(category) IN {_GROUPS['sized']} AND lower(category_b) IN {_GROUPS['sized']})")
_NAMES = "SELECT a, b, similarity FROM (SELECT x.t AS a, y.t AS b, len(list_intersect(x.w, y.w)) / CAST(len(list_distinct(list_concat(x.w, y.w))) AS DOUBLE) AS similarity FROM (SELECT DISTINCT name || ' ' || brand AS t, string_split(lower(name || ' ' || brand), ' ') AS w FROM messy) x, (SELECT DISTINCT name || ' ' || brand AS t, string_split(lower(name || ' ' || brand), ' ') AS w FROM messy) y WHERE x.t < y.t) WHERE similarity >= 0.5"
_named = lambda df: df.withColumn("full_name", F.concat_ws(" ", "name", "brand"))
_over("text_sim_join", "messy", lambda df: joins.jaccard_join(_named(df), "full_name", 0.5), _NAMES)
_over("text_sim_topk", "messy", lambda df: joins.jaccard_join(_named(df), "full_name", 0.5, 3),
      f"SELECT a, b, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS rank FROM ({_NAMES})) WHERE rank <= 3")
_DOT = "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COSINE = f"""SELECT q.vec_id AS query_id, v.vec_id, {_DOT.format('q', 'v')} / (sqrt({_DOT.format('q', 'q')}) * sqrt({_DOT.format('v', 'v')})) AS cosine
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0"""
_NEAREST = f"""SELECT query_id, vec_id, round(cosine, 4) AS cosine, CAST(rank AS INT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM ({_COSINE})) WHERE rank <= 5"""


def _nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.cosine_topk(vectors, vectors.filter("vec_id % 50 = 0"), 5).withColumn("cosine", F.round("cosine", 4))


def _alike(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest.cosine_above(vectors, vectors.filter("vec_id % 50 = 0"), 0.3)
    return found.withColumn("cosine", F.round("cosine", 4))


QUERIES["embedding_topk"] = QUERIES["embedding_topk_all"] = (_nearest, _NEAREST)
QUERIES["embedding_threshold"] = (_alike, f"SELECT query_id, vec_id, round(cosine, 4) AS cosine FROM ({_COSINE}) WHERE cosine >= 0.3E0")


def _hash_near(spark, sf_dir):
    """The vectors, and each once more with one component negated, as a second image would be."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    turned = F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % 64, -x).otherwise(x))
    return joins.hash_near(vectors.unionByName(vectors.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), turned.alias("embedding"))))


QUERIES["hash_neardup"] = (
    _hash_near,
    """WITH e AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x, i: CASE WHEN i - 1 = vec_id % 64 THEN -x ELSE x END) FROM embeddings),
    h AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(pow(2, i) AS HUGEINT) ELSE 0 END)) AS h FROM e),
    f AS (SELECT h, min(vec_id) AS rep FROM h GROUP BY h)
    SELECT x.rep AS a, y.rep AS b, 1 - bit_count(xor(CAST(x.h AS HUGEINT), CAST(y.h AS HUGEINT))) / 64.0E0 AS similarity FROM f x JOIN f y ON x.rep < y.rep WHERE bit_count(xor(CAST(x.h AS HUGEINT), CAST(y.h AS HUGEINT))) <= 4
    UNION ALL SELECT f.rep, h.vec_id, 1.0E0 FROM h JOIN f USING (h) WHERE h.vec_id <> f.rep""",
)
_COLUMNS = "product_id, name, price, price_2, diff_2, pct_2, qty_2, seller_2, price_3, diff_3, pct_3, seller_3"
QUERIES["first_stage"] = (
    lambda spark, sf_dir: joins.first_stage(view(spark, sf_dir, "catalog"), view(spark, sf_dir, "offers")).drop("qty_3"),
    oracle("first_stage", f"SELECT {_COLUMNS} FROM first_stage"),
)
_two("no_match_rows", "catalog", "offers", lambda c, o: joins.with_placeholders(c, o.filter("price < 900"), "c2").withColumn("offer_id", F.coalesce("offer_id", F.lit(-1))),
     "SELECT product_id, offer_id, price, 'OK' AS status FROM offers WHERE channel = 'c2' AND price < 900 UNION ALL SELECT product_id, -1, NULL, 'no same product' FROM catalog WHERE product_id NOT IN (SELECT product_id FROM offers WHERE channel = 'c2' AND price < 900)")
_two("unmatched_sources", "catalog", "offers", lambda c, o: c.join(o.filter(F.col("price") < F.col("product_id") % 400), "product_id", "left_anti").select("product_id", "name"),
     "SELECT product_id, name FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.product_id = c.product_id AND o.price < o.product_id % 400)")
_two("undercut_semi", "catalog", "offers", lambda c, o: c.alias("c").join(o.alias("o"), (F.col("c.product_id") == F.col("o.product_id")) & (F.col("o.price") < F.col("c.price")), "left_semi").select("product_id", "name", "price"),
     "SELECT product_id, name, price FROM catalog c WHERE EXISTS (SELECT 1 FROM offers o WHERE o.product_id = c.product_id AND o.price < c.price)")
_two("attach_by_url_id", "messy", "catalog",
     lambda m, c: m.select("product_id", url_id(F.col("raw_url"), "no").alias("id")).join(c.select(F.col("product_id").cast("string").alias("id"), F.concat("name", F.lit(".jpg")).alias("image")), "id", "left").select("product_id", F.coalesce("image", F.lit("default.jpg")).alias("image")),
     "SELECT m.product_id, coalesce(c.name || '.jpg', 'default.jpg') AS image FROM messy m LEFT JOIN catalog c ON CAST(c.product_id AS STRING) = coalesce(nullif(regexp_extract(m.raw_url, '[?&]no=(\\d+)', 1), ''), md5(m.raw_url))")
_over("edit_ratio", "messy", lambda df: _neighbours(df).select("name", "name_b").distinct().select("name", "name_b", scores.edit_ratio("name", "name_b").alias("ratio")), None)
_over("levenshtein_filter", "messy", lambda df: _neighbours(df).select("product_id", F.levenshtein("name", "name_b").alias("edits")).filter("edits <= 6"),
      f"SELECT product_id, levenshtein(name, name_b) AS edits FROM ({_NEXT}) WHERE levenshtein(name, name_b) <= 6")
_over("token_jaccard", "messy", lambda df: _neighbours(df).select("product_id", scores.token_jaccard(F.concat_ws(" ", "name", "category"), F.concat_ws(" ", "name_b", "category_b")).alias("jaccard")),
      f"SELECT product_id, len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) AS jaccard FROM (SELECT product_id, list_distinct(string_split(lower(name || ' ' || category), ' ')) AS x, list_distinct(string_split(lower(name_b || ' ' || category_b), ' ')) AS y FROM ({_NEXT}))")


def _cosines(df):
    """The cosine of each distinct pair of names, written once, and joined back to its products."""
    near = _neighbours(df).select("product_id", "name", "name_b")
    names = near.select(F.col("name").alias("a"), F.col("name_b").alias("b")).distinct()
    scored = checkpoint(names.withColumn("cosine", F.round(scores.tfidf_cosine(F.col("a"), F.col("b")), 6)))
    return near.join(small(scored), F.col("name").eqNullSafe(F.col("a")) & F.col("name_b").eqNullSafe(F.col("b"))).select("product_id", "cosine")


_W = "1 + ln(1.5E0)"
_over("tfidf_pair_cosine", "messy", _cosines,
      f"""SELECT product_id, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / sqrt((len(list_intersect(x, y)) + (len(x) - len(list_intersect(x, y))) * ({_W}) * ({_W})) * (len(list_intersect(x, y)) + (len(y) - len(list_intersect(x, y))) * ({_W}) * ({_W}))), 6) AS cosine
      FROM (SELECT product_id, list_append(string_split(name, ' '), name) AS x, list_append(string_split(name_b, ' '), name_b) AS y FROM ({_NEXT}))""")  # fmt: skip
_over("spec_similarity", "messy", lambda df: _neighbours(df).select("product_id", scores.spec_similarity(F.col("raw_name"), F.concat("raw_b", F.lit(" 500 ml"))).alias("spec")),
      "SELECT a.product_id, CASE WHEN contains(a.raw_name, '500ml') THEN 1.0E0 ELSE 0.5E0 END AS spec FROM messy a JOIN messy b ON b.product_id = a.product_id + 1")


def _text_score(df):
    """Scores of the distinct pairs of names, joined back to their products."""
    near = _neighbours(df)
    names = near.select("raw_name", "raw_b").distinct()
    scored = scores.score_names(names, "raw_name", "raw_b", scores.edit_ratio, "score")
    return near.join(small(scored), ["raw_name", "raw_b"]).select("product_id", "score")


_over("text_score", "messy", _text_score, None)
#: Which category a channel puts its offer in: none, the product's, or another one.
_OFFER_CATEGORY = "CASE offer_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Standard ' WHEN 2 THEN lower(category) ELSE category END"
#: How a channel titles what it offers.
_TITLE = "CASE offer_id % 4 WHEN 0 THEN name WHEN 1 THEN concat('new ', name, ' 500ml') WHEN 2 THEN concat(brand, ' ', name) ELSE concat(category, CASE WHEN offer_id % 7 = 0 THEN ' 홍보' WHEN offer_id % 7 = 1 THEN ' ' || name ELSE ' [x] (y)' END) END"


def matched(spark, sf_dir, edit=scores.edit_ratio, drop_filter_words=True):
    """The best offer of each product and channel, from names to the choice (joins.match_path)."""
    products = view(spark, sf_dir, "catalog")
    offers = view(spark, sf_dir, "offers").withColumnRenamed("price", "offer_price")
    image = F.when(F.col("offer_id") % 3 > 0, F.col("offer_id") % 97 / 96.0)
    candidates = merged(offers).join(products.select("product_id", "name", "brand", "category"), "product_id").select(
        "product_id", "offer_id", "channel", "seller", "qty", "offer_price", F.expr(_TITLE).alias("title"), F.expr(_OFFER_CATEGORY).alias("offer_category"), image.alias("image_sim")
    )
    return joins.match_path(products, candidates, edit, least=0.3, least_text=0.3, least_image=0.1, groups=_GROUPS, drop_filter_words=drop_filter_words)


def _matched_stage(spark, sf_dir):
    """The first-stage table of the chosen offers, and of it the undercut products."""
    chosen = matched(spark, sf_dir).select("product_id", "channel", "offer_id", "seller", "qty", F.col("offer_price").alias("price"))
    return rules.second_stage(joins.first_stage(view(spark, sf_dir, "catalog"), chosen))


_EDITS = "(1.0E0 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE))"


def _matched_by_edits(spark, sf_dir):
    """The match path with Levenshtein's distance for the edit ratio, which SQL has too."""
    edits = lambda a, b: 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    found = matched(spark, sf_dir, edits)
    return found.select("product_id", "channel", "offer_id", "title", F.round("combined", 6).alias("combined"), "offer_price")


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g'), '[^\w가-힣\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
_NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\w가-힣\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_TERMS = "list_filter(string_split({0}, ' '), lambda w: length(w) > 1)"
_COUNT = "CAST(len(list_filter({0}, lambda u: u = t)) AS DOUBLE)"
_DOT_TERMS = f"coalesce(list_sum(list_transform(list_distinct(list_intersect(x, y)), lambda t: {_COUNT.format('x')} * {_COUNT.format('y')})), 0.0E0)"
_NORM = f"list_sum(list_transform(list_distinct({{0}}), lambda t: pow({_COUNT.format('{0}')} * CASE WHEN list_contains({{1}}, t) THEN 1.0E0 ELSE 1 + ln(1.5E0) END, 2)))"
_MATCH_STEPS = f"""c AS (
  SELECT o.product_id, o.offer_id, o.channel, o.seller, o.price AS offer_price, p.price, p.name, p.category, {_TITLE} AS title,
    {_OFFER_CATEGORY} AS offer_category, CASE WHEN offer_id % 3 > 0 THEN offer_id % 97 / 96.0E0 END AS image_sim
  FROM offers o JOIN catalog p ON o.product_id = p.product_id
), passed AS (
  SELECT *, lower(trim(coalesce(category, ''))) AS ca, lower(trim(coalesce(offer_category, ''))) AS cb FROM c
  WHERE offer_id <> product_id AND NOT contains(title, '홍보') AND (image_sim IS NULL OR image_sim >= 0.1E0)
    AND (coalesce(price, 0) <= 0 OR coalesce(offer_price, 0) <= 0 OR abs(price - offer_price) / greatest(price, offer_price) <= 0.3E0)
), fitting AS (
  SELECT *, {_NORMAL.format(_CLEAN.format('name'))} AS na, {_NORMAL.format(_CLEAN.format('title'))} AS nb FROM passed
  WHERE ca = '' OR cb = '' OR ca = cb OR (ca IN {_GROUPS['basic']} AND cb IN {_GROUPS['basic']}) OR (ca IN {_GROUPS['sized']} AND cb IN {_GROUPS['sized']})
), words AS (
  SELECT *, {_TERMS.format('na')} AS wa, {_TERMS.format('nb')} AS wb FROM (SELECT DISTINCT name, title, na, nb FROM fitting)
), terms AS (
  SELECT *, list_concat(wa, list_transform(range(1, len(wa)), lambda i: wa[i] || ' ' || wa[i + 1])) AS x,
    list_concat(wb, list_transform(range(1, len(wb)), lambda i: wb[i] || ' ' || wb[i + 1])) AS y FROM words
), scored AS (
  SELECT *, {_DOT_TERMS} AS product, {_NORM.format('x', 'y')} AS nx, {_NORM.format('y', 'x')} AS ny FROM terms
), texts AS (
  SELECT *, CASE WHEN na = '' OR nb = '' THEN 0.0E0 ELSE {_EDITS.format('na', 'nb')} * 0.3E0 + 0.7E0 * CASE WHEN len(x) = 0 AND len(y) = 0 THEN 0.5E0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0E0
    ELSE product / sqrt(nx * ny) END END AS text_sim FROM scored
), weights AS (
  SELECT *, greatest(0.7E0 * CASE WHEN text_sim > 0.9E0 THEN 1.2E0 WHEN text_sim < 0.3E0 THEN 0.8E0 ELSE 1.0E0 END * CASE WHEN image_sim > 0.9E0 THEN 0.8E0 WHEN image_sim < 0.3E0 THEN 1.2E0 ELSE 1.0E0 END, 0.3E0) AS wt,
    greatest(0.3E0 * CASE WHEN text_sim > 0.9E0 THEN 0.8E0 WHEN text_sim < 0.3E0 THEN 1.2E0 ELSE 1.0E0 END * CASE WHEN image_sim > 0.9E0 THEN 1.2E0 WHEN image_sim < 0.3E0 THEN 0.8E0 ELSE 1.0E0 END, 0.2E0) AS wi
  FROM fitting JOIN (SELECT name, title, text_sim FROM texts) USING (name, title) WHERE text_sim >= 0.3E0
), combined AS (
  SELECT *, round(CASE WHEN image_sim IS NULL THEN text_sim ELSE text_sim * wt / (wt + wi) + image_sim * wi / (wt + wi) END, 9) AS combined FROM weights
), tops AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, channel ORDER BY combined DESC, offer_id, offer_price, seller) AS rank FROM combined WHERE combined >= 0.3E0
), chosen AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, channel ORDER BY CASE WHEN combined > 0.75E0 THEN 0 ELSE 1 END,
    CASE WHEN combined > 0.75E0 THEN CASE WHEN offer_price > 0 THEN offer_price ELSE 1.0E300 END ELSE 0.0E0 END, combined DESC, offer_id, offer_price, seller) AS rn
  FROM tops WHERE rank <= 5
)
SELECT product_id, channel, offer_id, title, round(combined, 6) AS combined, offer_price FROM chosen WHERE rn = 1"""
QUERIES["match_path_by_edits"] = (
    _matched_by_edits,
    oracle("catalog", "").strip() + f", {oracle('offers', '').strip().removeprefix('WITH ')}, {_MATCH_STEPS}",
)
QUERIES["match_path"] = (lambda spark, sf_dir: matched(spark, sf_dir).select("product_id", "channel", "offer_id", "title", "combined", "offer_price"), None)
QUERIES["matched_second_stage"] = (_matched_stage, None)
_over("histogram_similarity", "messy", lambda df: df.select("product_id", scores.histogram_similarity(F.array(*[(F.col("product_id") % m) / float(m) for m in (3, 5, 7, 11)]), F.array(*[(F.col("size") % m) / float(m) for m in (3, 5, 7, 11)])).alias("similarity")),
      "SELECT product_id, (0.0E0 + " + " + ".join(f"(1 - least(abs(product_id % {m} / {m}.0E0 - size % {m} / {m}.0E0), 1.0E0))" for m in (3, 5, 7, 11)) + ") / 4 AS similarity FROM messy")
_RANKED = "row_number() OVER (PARTITION BY product_id ORDER BY {0} DESC, offer_id, offer_price, seller)".format("combined")
_TOP = f"SELECT *, {_RANKED} AS rank FROM (SELECT *, {_TEXT} AS combined FROM pairs) WHERE combined >= 0.3E0"
_over("topk_matches", "pairs", lambda df: joins.topk(_combined(df), 5, 0.3).select("product_id", "offer_id", "combined", "rank"), f"SELECT product_id, offer_id, combined, CAST(rank AS INT) AS rank FROM ({_TOP}) WHERE rank <= 5")
_over("best_match", "pairs", lambda df: joins.best_match(_combined(df), 5, 0.3, 0.7).select("product_id", "offer_id", "combined", "offer_price"),
      f"SELECT product_id, offer_id, combined, offer_price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN combined > 0.7E0 THEN 0 ELSE 1 END, CASE WHEN combined > 0.7E0 THEN offer_price ELSE 0.0E0 END, combined DESC, offer_id, offer_price, seller) AS rn FROM ({_TOP}) WHERE rank <= 5) WHERE rn = 1")
_over("cheapest_candidates", "pairs", lambda df: joins.cheapest(df, 10, F.col("qty") > 10, page=4, pages=3).select("product_id", "offer_id", "offer_price", "rank"),
      "SELECT product_id, offer_id, offer_price, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY offer_price, offer_id, seller) AS rank FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY offer_price, offer_id, seller) AS seen FROM pairs) WHERE seen <= 12) WHERE qty > 10) WHERE rank <= 10")
_over("lowest_offer", "pairs", lambda df: df.groupBy("product_id").agg(F.min("offer_price").alias("lowest"), F.min_by("offer_id", F.struct("offer_price", "offer_id")).alias("offer_id")),
      "SELECT product_id, offer_price AS lowest, offer_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY offer_price, offer_id) AS rn FROM pairs) WHERE rn = 1")
