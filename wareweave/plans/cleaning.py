"""Queries of the cleaning projections (names, codes, prices, URLs, statuses)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareweave.functions import money, scores, text, urls
from wareweave.plans.views import oracle, view
from wareweave.sources.sheets import strip_at

QUERIES: dict = {}


def _project(name: str, sql: str, *columns: tuple[str, Column], source: str = "messy", key: str = "product_id") -> None:
    """Register a projection of a view and its oracle over the same view."""

    def run(spark, sf_dir):
        return view(spark, sf_dir, source).select(key, *(c().alias(n) for n, c in columns))

    QUERIES[name] = (run, oracle(source, f"SELECT {key}, {sql} FROM {source}"))


_col = F.col
_SPACES = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_NOISE = "regexp_replace(regexp_replace(raw_name, '\\s*//.*', ''), '(\\d{4}_[A-Z]\\.)|(\\d+\\+\\d+)|[^a-zA-Z0-9가-힣\\s]', ' ', 'g')"
for _word in text.NOISE_KEYWORDS:
    _NOISE = f"replace({_NOISE}, '{_word}', '')"
_NORMAL = "lower(title)"
for _brand, _aliases in text.BRAND_ALIASES.items():
    for _alias in _aliases:
        if _alias.isascii():  # the driver's names hold no other script next to these
            _NORMAL = rf"regexp_replace({_NORMAL}, '\b{_alias}\b', '{_brand}', 'g')"
_NORMAL = _SPACES.format(rf"regexp_replace({_NORMAL}, '[^\w가-힣\s]', ' ', 'g')")
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_ANY = lambda c, words: f"regexp_matches({c}, '{'|'.join(dict.fromkeys(words))}')"

_project("clean_name_basic", r"trim(regexp_replace(regexp_replace(raw_name, '^\d+-', ''), '[/()]', '', 'g')) AS clean",
         ("clean", lambda: text.clean_name_basic(_col("raw_name"))))
_project("clean_name_keywords", f"{_SPACES.format(_NOISE)} AS clean", ("clean", lambda: text.clean_name(_col("raw_name"))))
_project("search_key", _SPACES.format(r"translate(regexp_replace(regexp_replace(regexp_replace(raw_name, '^\d+-', ''), '^\d+\s*-\s*', ''), '\(\d+\)', '', 'g'), '/_', '  ')") + " AS search_key",
         ("search_key", lambda: text.search_key(_col("raw_name"))))
_project("clean_name_match", _SPACES.format(r"regexp_replace(regexp_replace(regexp_replace(raw_name, '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g'), '[^\w가-힣\s-]', ' ', 'g')") + " AS clean",
         ("clean", lambda: text.clean_name_match(_col("raw_name"))))
_project("clean_code", "CASE WHEN raw_code IS NULL OR raw_code = '' THEN '' ELSE coalesce(nullif(regexp_replace(trim(raw_code), '[^A-Za-z0-9-]', '', 'g'), ''), 'CODE-' || md5(raw_code || CAST(product_id AS STRING))) END AS code",
         ("code", lambda: text.clean_code(_col("raw_code"), F.concat(F.lit("CODE-"), F.md5(F.concat("raw_code", F.col("product_id").cast("string")).cast("binary"))))))
_project("coalesce_code", "coalesce(nullif(trim(raw_code), ''), nullif(trim(brand), ''), '') AS code", ("code", lambda: text.first_filled(_col("raw_code"), _col("brand"))))
_project("clean_price", r"""CASE WHEN raw_price IS NULL OR (digits <> '' AND try_cast(digits AS DOUBLE) IS NULL) THEN 0.0 ELSE least(greatest(coalesce(try_cast(digits AS DOUBLE), 0.0), 100.0), 10000.0) END AS clean""".replace("digits", r"regexp_replace(raw_price, '[^\d.]', '', 'g')"),
         ("clean", lambda: money.clean_price(_col("raw_price"), 100.0, 10000.0)))
_project("to_numeric", f"CASE WHEN raw_price NOT IN {_IN(money.NOT_NUMBERS)} THEN try_cast(replace(raw_price, ',', '') AS DOUBLE) END AS value", ("value", lambda: money.to_numeric(_col("raw_price"))))
_project("extract_price_qty", r"""try_cast(replace(regexp_extract(raw_price, '([\d,]*\d[\d,]*)', 1), ',', '') AS DOUBLE) AS price_found,
  try_cast(regexp_extract(raw_qty, '(\d+)(개|세트|묶음)', 1) AS DOUBLE) AS qty_found""",
         ("price_found", lambda: money.first_number(_col("raw_price")).cast("double")), ("qty_found", lambda: money.first_quantity(_col("raw_qty")).cast("double")))
_project("clean_url", "CASE WHEN raw_url IS NULL OR trim(raw_url) IN ('', 'nan') THEN '' WHEN regexp_matches(trim(raw_url), '^https?://') THEN trim(raw_url) ELSE 'https://' || trim(raw_url) END AS url",
         ("url", lambda: urls.clean_url(_col("raw_url"))))
_UNWRAP = "CASE WHEN raw_url LIKE '=IMAGE(%' THEN regexp_extract(raw_url, '^=IMAGE\\(\"([^\"]*)\"', 1) ELSE raw_url END"
_IMAGE = f"trim(translate({_UNWRAP}, '\"''', ''))"
_CLEAN_IMAGE = f"CASE WHEN {_IMAGE} IS NULL OR {_IMAGE} = '' OR lower({_IMAGE}) IN {_IN(urls.NO_IMAGE)} THEN '' WHEN regexp_matches({_IMAGE}, '(?i)^https?://') THEN {_IMAGE} WHEN starts_with({_IMAGE}, '//') THEN 'https:' || {_IMAGE} ELSE 'https://' || {_IMAGE} END"
_END = urls.IMAGE_END
_project("clean_image_url", f"{_CLEAN_IMAGE} AS url, regexp_matches({_CLEAN_IMAGE}, '{_END}') OR regexp_matches({_CLEAN_IMAGE}, '{urls.IMAGE_PARTS}') AS likely_image",
         ("url", lambda: urls.clean_image_url(_col("raw_url"))), ("likely_image", lambda: urls.likely_image(urls.clean_image_url(_col("raw_url")))))
_T = "translate(trim(raw_url), '@', '')"
_SCHEMED = f"CASE WHEN starts_with({_T}, 'http:') THEN 'https:' || substr({_T}, 6) WHEN starts_with({_T}, '//') THEN 'https:' || {_T} WHEN NOT regexp_matches({_T}, '^[a-z]+:') AND contains({_T}, '.') THEN 'https://' || {_T} ELSE {_T} END"
_project("normalize_url", f"""replace(replace(translate({_SCHEMED}, chr(92), '/'), '"', '%22'), ' ', '%20') AS url""", ("url", lambda: urls.normalize_url(_col("raw_url"))))
QUERIES["strip_at"] = (
    lambda spark, sf_dir: strip_at(view(spark, sf_dir, "messy").select("product_id", "raw_url", "raw_name", "price", "brand")),
    oracle("messy", "SELECT product_id, replace(raw_url, '@', '') AS raw_url, replace(raw_name, '@', '') AS raw_name, price, replace(brand, '@', '') AS brand FROM messy"),
)
_project("image_formula", f"""CASE WHEN coalesce(trim({_UNWRAP}), '') = '' THEN '' ELSE '=IMAGE("' || {_UNWRAP} || '", 2)' END AS formula, {_UNWRAP} AS plain""",
         ("formula", lambda: urls.image_formula(urls.unwrap_image(_col("raw_url")))), ("plain", lambda: urls.unwrap_image(_col("raw_url"))))
_project("normalize_types", "coalesce(raw_code, '') AS raw_code, coalesce(try_cast(raw_price AS DOUBLE), 0.0) AS price, CASE WHEN division IN ('A', 'P') THEN division ELSE 'A' END AS division",
         ("raw_code", lambda: F.coalesce("raw_code", F.lit(""))), ("price", lambda: F.coalesce(_col("raw_price").try_cast("double"), F.lit(0.0))),
         ("division", lambda: F.when(_col("division").isin("A", "P"), _col("division")).otherwise("A")))
_project("derive_status", "CASE WHEN trim(raw_name) = '' THEN 'Not Found' WHEN try_cast(raw_price AS DOUBLE) IS NULL OR try_cast(raw_price AS DOUBLE) = 0 THEN 'Price Not Found' WHEN trim(raw_url) = '' THEN 'Image Not Found' ELSE 'OK' END AS status",
         ("status", lambda: text.derive_status(_col("raw_name"), _col("raw_price").try_cast("double"), _col("raw_url"))))
_project("promo_flag", f"{_ANY('lower(title)', text.PROMO_WORDS)} OR {_ANY('lower(brand)', text.PROMO_WORDS)} OR {_ANY('lower(category)', text.PROMO_CATEGORIES)} AS promo",
         ("promo", lambda: text.promo_flag(_col("title"), _col("brand"), _col("category"))))
_project("url_param_id", r"coalesce(nullif(regexp_extract(raw_url, '[?&]no=(\d+)', 1), ''), md5(raw_url)) AS id", ("id", lambda: urls.url_id(_col("raw_url"), "no")))
_project("stock_status", "CASE WHEN contains(raw_stock, '품절') OR contains(lower(raw_stock), 'sold out') THEN 'Out of Stock' WHEN contains(lower(raw_stock), 'temporarily out') THEN 'Temporarily Out of Stock' WHEN contains(raw_stock, '재고') AND (contains(raw_stock, '부족') OR contains(raw_stock, '없')) THEN 'Low Stock' ELSE 'In Stock' END AS stock",
         ("stock", lambda: text.stock_status(_col("raw_stock"))))
_project("image_url_filter", f"regexp_matches(raw_url, '{_END}') AND NOT regexp_matches(raw_url, '{urls.UI_PARTS}') AS shown, coalesce(regexp_matches(lower(raw_url), '{'|'.join(p.replace('.', '[.]') for p in urls.SHOP_UI_PARTS)}'), false) AS shop_ui",
         ("shown", lambda: urls.shown_image(_col("raw_url"))), ("shop_ui", lambda: urls.shop_ui_image(_col("raw_url"))))
_GALLERY_SQL = "[name || '.png', 'small/' || CAST(product_id AS STRING) || '.jpg', 'https://img.example.com/' || CAST(size AS STRING) || '.jpg']"


def _gallery() -> Column:
    number = lambda c: _col(c).cast("string")
    return F.array(
        F.concat("name", F.lit(".png")),
        F.concat(F.lit("small/"), number("product_id"), F.lit(".jpg")),
        F.concat(F.lit("https://img.example.com/"), number("size"), F.lit(".jpg")),
    )


_HOST = "https://img.example.com"
_WHOLE_SQL = f"CASE WHEN regexp_matches(u, '^https?://') THEN u WHEN starts_with(u, '//') THEN 'https:' || u WHEN starts_with(u, '/') THEN '{_HOST}' || u ELSE '{_HOST}/' || u END"
_project("repair_gallery", f"array_to_string(list_transform({_GALLERY_SQL}, lambda u: {_WHOLE_SQL}), ',') AS gallery, CASE WHEN trim(raw_url) IN ('', 'none') THEN '{_HOST}/shop_' || CAST(product_id AS STRING) || '_0.jpg' ELSE (SELECT {_WHOLE_SQL} FROM (SELECT trim(raw_url) AS u)) END AS image",
         ("gallery", lambda: F.array_join(urls.repair_gallery(_gallery(), _HOST, _col("product_id")), ",")), ("image", lambda: urls.repair_image(_col("raw_url"), _HOST, _col("product_id"), ("none",))))


def _some_png() -> Column:
    return F.when(_col("product_id") % 3 == 0, F.array(F.concat("name", F.lit(".PNG")))).otherwise(_gallery())


_project("pick_image", f"CASE WHEN product_id % 3 = 0 THEN 'missing' ELSE list_filter({_GALLERY_SQL}, lambda u: NOT ends_with(lower(u), '.png'))[1] END AS image, CASE WHEN product_id % 3 = 0 THEN 'Image Not Found' ELSE 'OK' END AS status",
         ("image", lambda: urls.pick_image(_some_png(), "missing")), ("status", lambda: urls.pick_status(_some_png())))
_project("gallery_text", f"array_to_string({_GALLERY_SQL}[1:5], ' | ') AS gallery", ("gallery", lambda: urls.gallery_text(_gallery())))
_project("vat_gross_up", r"CASE WHEN regexp_matches(title, '(?i)VAT\s*(포함|별도|제외)') THEN price ELSE price * CAST(1.1 AS DOUBLE) END AS gross, CAST(trunc(CASE WHEN regexp_matches(title, '(?i)VAT\s*(포함|별도|제외)') THEN price ELSE price * CAST(1.1 AS DOUBLE) END) AS BIGINT) AS page_price",
         ("gross", lambda: money.vat_gross_up(_col("price"), _col("title"))), ("page_price", lambda: money.vat_gross_up(_col("price"), _col("title")).cast("long")))
_project("clean_quantity", r"CAST(CASE WHEN contains(raw_qty, '미만') THEN greatest(try_cast(regexp_replace(replace(raw_qty, '천부', '000'), '[^\d]', '', 'g') AS INT) - 1, 0) ELSE try_cast(regexp_replace(replace(raw_qty, '천부', '000'), '[^\d]', '', 'g') AS INT) END AS DOUBLE) AS qty",
         ("qty", lambda: money.clean_quantity(_col("raw_qty")).cast("double")))
_project("normalize_name", f"{_NORMAL} AS name", ("name", lambda: text.normalize_name(_col("title"))))
_project("key_terms", f"array_to_string(list_filter(string_split({_NORMAL}, ' '), lambda w: w <> '' AND w NOT IN {_IN(text.PRODUCT_TYPES)}), ' ') AS terms",
         ("terms", lambda: F.array_join(text.key_terms(_col("title")), " ")))
_VOLUME = text.SPEC_PATTERNS["volume"].replace("'", "''")
_WEIGHT = text.SPEC_PATTERNS["weight"].replace("'", "''")
_project("extract_specs", f"array_to_string(regexp_extract_all(raw_name, '{_VOLUME}', 1), ',') AS volume, array_to_string(regexp_extract_all(raw_name, '{_WEIGHT}', 1), ',') AS weight",
         ("volume", lambda: F.coalesce(F.array_join(text.extract_specs(_col("raw_name"))["volume"], ","), F.lit(""))),
         ("weight", lambda: F.coalesce(F.array_join(text.extract_specs(_col("raw_name"))["weight"], ","), F.lit(""))))
_project("number_context", "", ("contexts", lambda: F.array_join(text.number_context(_col("raw_name")), "|")))
QUERIES["number_context"] = (QUERIES["number_context"][0], None)
_project("price_similarity", "CASE WHEN greatest(price, offer_price) > 0 AND 1 - abs(price - offer_price) / greatest(price, offer_price) >= 0.15E0 THEN (1 - abs(price - offer_price) / greatest(price, offer_price)) * 0.2E0 ELSE 0.0E0 END AS similarity",
         ("similarity", lambda: money.price_similarity(_col("price"), _col("offer_price"))), source="pairs", key="offer_id")
_project("price_diff", "product_id, CASE WHEN price > 0 AND offer_price <> 0 THEN offer_price - price ELSE 0.0E0 END AS diff, CASE WHEN price > 0 AND offer_price <> 0 THEN (offer_price - price) / price * 100 ELSE 0.0E0 END AS pct",
         ("product_id", lambda: _col("product_id")), ("diff", lambda: money.price_diff(_col("price"), _col("offer_price"))), ("pct", lambda: money.price_diff_pct(_col("price"), _col("offer_price"))), source="pairs", key="offer_id")
_project("price_diff_report", "CASE WHEN price > 0 AND price_2 > 0 THEN price_2 - price END AS diff, CASE WHEN price > 0 AND price_2 > 0 THEN (price_2 - price) / nullif(price, 0) END AS fraction",
         ("diff", lambda: F.when((_col("price") > 0) & (_col("price_2") > 0), _col("price_2") - _col("price"))),
         ("fraction", lambda: F.when((_col("price") > 0) & (_col("price_2") > 0), F.try_divide(_col("price_2") - _col("price"), _col("price")))), source="first_stage")
_project("cross_channel_diff", "price_2 - price_3 AS c2_less_c3, price_3 - price_2 AS c3_less_c2, round((price_2 - price_3) * 100 / nullif(price_3, 0), 2) AS pct_of_c3, round((price_3 - price_2) * 100 / nullif(price_2, 0), 2) AS pct_of_c2",
         ("c2_less_c3", lambda: _col("price_2") - _col("price_3")), ("c3_less_c2", lambda: _col("price_3") - _col("price_2")),
         ("pct_of_c3", lambda: F.round(F.try_divide((_col("price_2") - _col("price_3")) * 100, _col("price_3")), 2)), ("pct_of_c2", lambda: F.round(F.try_divide((_col("price_3") - _col("price_2")) * 100, _col("price_2")), 2)), source="first_stage")
_T0 = "CASE WHEN text_sim > 0.9E0 THEN 0.7E0 * 1.2E0 WHEN text_sim < 0.3E0 THEN 0.7E0 * 0.8E0 ELSE 0.7E0 END"
_I0 = "CASE WHEN text_sim > 0.9E0 THEN 0.3E0 * 0.8E0 WHEN text_sim < 0.3E0 THEN 0.3E0 * 1.2E0 ELSE 0.3E0 END"
_T1 = f"greatest(CASE WHEN image_sim > 0.9E0 THEN ({_T0}) * 0.8E0 WHEN image_sim < 0.3E0 THEN ({_T0}) * 1.2E0 ELSE {_T0} END, 0.3E0)"
_I1 = f"greatest(CASE WHEN image_sim > 0.9E0 THEN ({_I0}) * 1.2E0 WHEN image_sim < 0.3E0 THEN ({_I0}) * 0.8E0 ELSE {_I0} END, 0.2E0)"
_WT, _WI = f"CASE WHEN has_images THEN {_T1} / ({_T1} + {_I1}) ELSE 1.0E0 END", f"CASE WHEN has_images THEN {_I1} / ({_T1} + {_I1}) ELSE 0.0E0 END"


def _weights() -> Column:
    return scores.adaptive_weights(_col("text_sim"), _col("image_sim"), _col("has_images"))


_project("adaptive_weights", f"{_WT} AS w_text, {_WI} AS w_image", ("w_text", lambda: _weights()["w_text"]), ("w_image", lambda: _weights()["w_image"]), source="pairs", key="offer_id")
_project("combined_score", f"text_sim * ({_WT}) + image_sim * ({_WI}) AS combined", ("combined", lambda: _col("text_sim") * _weights()["w_text"] + _col("image_sim") * _weights()["w_image"]), source="pairs", key="offer_id")
_PARTS = ("text_sim", "image_sim", "text_sim * image_sim", "1 - text_sim", "1 - image_sim")
_project("image_score_fusion", "CASE WHEN image_sim = 1.0E0 THEN 1.0E0 WHEN text_sim > 0.95E0 THEN 0.95E0 + (text_sim - 0.95E0) * 0.5E0 ELSE "
         + " + ".join(f"({p}) * {w}E0" for p, w in zip(_PARTS, ("0.15", "0.25", "0.10", "0.30", "0.10"), strict=True))
         + f" + CASE WHEN ({' + '.join(f'({p})' for p in _PARTS)}) / 5 < 0.3E0 THEN 0.0E0 ELSE text_sim END * 0.10E0 END AS fused",
         ("fused", lambda: scores.image_score(_col("text_sim"), _col("image_sim") == 1.0, [F.expr(p) for p in _PARTS], _col("text_sim"))), source="pairs", key="offer_id")
