"""Column functions that clean product names, codes and status texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the cleaning and filter rules name.
NOISE_KEYWORDS = (
    "정품", "NEW", "특가", "주문제작타올", "주문제작수건", "결혼답례품 수건",
    "답례품수건", "주문제작 수건", "돌답례품수건", "명절선물세트", "각종행사수건",
)
PROMO_WORDS = (
    "온오프마켓", "답례품", "기프트", "판촉", "기념품", "인쇄", "각인", "제작", "홍보",
    "미스터몽키", "호갱탈출", "고려기프트", "판촉물", "기업선물", "단체선물", "행사용품",
    "홍보물", "기업홍보", "로고인쇄", "로고각인", "로고제작", "기업답례품", "행사답례품",
    "기념품제작", "기업기념품",
)
PROMO_CATEGORIES = (
    "기업선물", "단체선물", "행사용품", "홍보물", "기업홍보", "로고인쇄", "로고각인",
    "로고제작", "기업답례품", "행사답례품", "기념품제작", "기업기념품", "기업홍보물",
    "기업홍보물제작", "기업홍보물인쇄", "기업홍보물각인",
)
FILTER_WORDS = ("판촉", "기프트", "답례품", "기념품", "인쇄", "각인", "제작", "호갱", "몽키", "홍보")
PRODUCT_TYPES = (
    "세트", "패키지", "번들", "묶음", "단품", "낱개", "개별", "리필", "교체", "충전",
    "최신형", "신형", "구형", "이전", "한정판", "스페셜", "특별판", "에디션", "기획", "할인",
    "프로모션", "이벤트", "대용량", "소용량", "미니", "점보", "프리미엄", "고급", "스탠다드", "기본형",
)
BRAND_ALIASES = {
    "삼성": ("samsung", "샘숭", "samseong", "삼성전자"),
    "LG": ("엘지", "엘쥐", "lg전자", "엘지전자"),
    "애플": ("apple", "아이폰", "iphone", "맥북", "macbook", "아이패드", "ipad"),
    "현대": ("hyundai", "현대자동차", "현대차"),
    "기아": ("kia", "기아자동차", "기아차"),
    "쿠팡": ("coupang", "쿠팡로켓배송"),
    "다이슨": ("dyson", "다이손"),
    "브라운": ("braun", "브라운전자"),
    "샤오미": ("xiaomi", "mi", "미"),
    "아이닉": ("ionic", "아이오닉"),
    "마이크로소프트": ("microsoft", "ms", "엠에스"),
    "나이키": ("nike",),
    "아디다스": ("adidas",),
    "퓨마": ("puma",),
    "필립스": ("philips", "필립스전자"),
    "일렉트로룩스": ("electrolux", "일렉트로럭스"),
}
SPEC_PATTERNS = {
    "size": r"(?i)(\d+[\s]*[x×][\s]*\d+[\s]*[x×]?[\s]*\d*[\s]*(?:mm|cm|m)?)",
    "weight": r"(?i)(\d+[\s]*(?:kg|g|t|mg))",
    "volume": r"(?i)(\d+[\s]*(?:ml|l|리터|oz|온스))",
    "screen": r"(?i)(\d+(?:\.\d+)?[\s]*(?:인치|inch|\"|'))",
}
SOLD_OUT, TEMPORARILY_OUT, LOW_STOCK, IN_STOCK = "Out of Stock", "Temporarily Out of Stock", "Low Stock", "In Stock"


def collapse(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_name_basic(c: Column) -> Column:
    """Drop a leading number and dash, then every slash and parenthesis."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\d+-", ""), r"[/()]", ""))


def clean_name(c: Column) -> Column:
    """Drop the comment, odd signs and noise words, the words in list order."""
    kept = F.regexp_replace(c, r"\s*//.*", "")
    kept = F.regexp_replace(kept, r"(\d{4}_[A-Z]\.)|(\d+\+\d+)|[^a-zA-Z0-9가-힣\s]", " ")
    return collapse(reduce(lambda a, word: F.replace(a, F.lit(word), F.lit("")), NOISE_KEYWORDS, kept))


def search_key(c: Column) -> Column:
    """The form in which a name is searched: no number prefix, no (digits), no slash or underscore."""
    kept = F.regexp_replace(F.regexp_replace(c, r"^\d+-", ""), r"^\d+\s*-\s*", "")
    return collapse(F.translate(F.regexp_replace(kept, r"\(\d+\)", ""), "/_", "  "))


def clean_name_match(c: Column) -> Column:
    """The form in which names are compared: no bracketed parts, no punctuation but dashes."""
    kept = F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), r"\(.*?\)", "")
    return collapse(F.regexp_replace(kept, r"(?U)[^\w\s-]", " "))


def clean_code(c: Column, fallback: Column) -> Column:
    """A code of letters, digits and dashes; the fallback where nothing is left of it."""
    kept = F.regexp_replace(F.trim(c), r"[^A-Za-z0-9-]", "")
    return F.when(c.isNull() | (c == ""), "").otherwise(F.coalesce(F.nullif(kept, F.lit("")), fallback))


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank, else ''."""
    return F.coalesce(*map(blank_to_null, columns), F.lit(""))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """True if any of the literal words occurs."""
    return F.coalesce(c.rlike("|".join(dict.fromkeys(words))), F.lit(False))


def promo_flag(title: Column, mall: Column, category: Column) -> Column:
    named = contains_any(F.lower(title), PROMO_WORDS) | contains_any(F.lower(mall), PROMO_WORDS)
    return named | contains_any(F.lower(category), PROMO_CATEGORIES)


def derive_status(name: Column, price: Column, image: Column) -> Column:
    """What a catalogue row lacks, the first lack named."""
    return (
        F.when(blank_to_null(name).isNull(), "Not Found")
        .when(price.isNull() | (price == 0), "Price Not Found")
        .when(blank_to_null(image).isNull(), "Image Not Found")
        .otherwise("OK")
    )


def stock_status(c: Column) -> Column:
    """Stock wording; "sold out" is tested first, so its compounds count as sold out."""
    low = F.lower(c)
    return (
        F.when(c.contains("품절") | low.contains("sold out"), SOLD_OUT)
        .when(low.contains("temporarily out"), TEMPORARILY_OUT)
        .when(c.contains("재고") & (c.contains("부족") | c.contains("없")), LOW_STOCK)
        .otherwise(IN_STOCK)
    )


def normalize_name(c: Column) -> Column:
    """Lower case, brand aliases to one name, punctuation to spaces."""
    out = F.lower(c)
    for brand, aliases in BRAND_ALIASES.items():
        for alias in aliases:
            out = F.regexp_replace(out, rf"(?U)\b{alias}\b", brand)
    return collapse(F.regexp_replace(out, r"(?U)[^\w\s]", " "))


def key_terms(c: Column) -> Column:
    """Words of the normalised name without product-type words, in order."""
    stop = F.array(*map(F.lit, PRODUCT_TYPES))
    return F.filter(F.split(normalize_name(c), " "), lambda w: (w != "") & ~F.array_contains(stop, w))


def spec_hits(c: Column, kind: str) -> Column:
    """Specifications of one kind: digits, Latin letters and signs of size only, so that a
    unit in another script does not count."""
    return F.transform(F.regexp_extract_all(c, F.lit(SPEC_PATTERNS[kind]), 1), lambda h: F.regexp_replace(F.lower(h), "[^0-9a-z×x]", ""))


def extract_specs(c: Column) -> Column:
    """Map from kind of specification to its hits, kinds without hits left out."""
    full = F.create_map(*[x for kind in SPEC_PATTERNS for x in (F.lit(kind), F.regexp_extract_all(c, F.lit(SPEC_PATTERNS[kind]), 1))])
    return F.map_filter(full, lambda _, hits: F.size(hits) > 0)


def number_context(c: Column, width: int = 10) -> Column:
    """Every number with up to ``width`` characters before and after it.

    What stands before a number is what stands after it in the reversed text, so both
    sides come from one pass each.
    """
    after = F.lit(rf"(?s)(\d+)(?=(.{{0,{width}}}))")
    back = F.reverse(c)
    before = F.reverse(F.transform(F.regexp_extract_all(back, after, 2), lambda part: F.reverse(part)))
    following = F.zip_with(F.regexp_extract_all(c, after, 1), F.regexp_extract_all(c, after, 2), lambda n, rest: F.concat(n, rest))
    return F.zip_with(before, following, lambda front, rest: F.concat(front, rest))
