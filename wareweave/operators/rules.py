"""Row rules on first-stage tables: undercut filters, validity, status texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of each channel's group, as far as a table has them.
GROUPS = {n: tuple(f"{c}_{n}" for c in ("price", "diff", "pct", "qty", "seller")) for n in ("2", "3")}


def true(c: Column) -> Column:
    """A predicate whose null counts as false, safe under negation."""
    return F.coalesce(c, F.lit(False))


def undercut() -> Column:
    """Any channel is cheaper."""
    return true(F.col("diff_2") < 0) | true(F.col("diff_3") < 0)


def valid_2() -> Column:
    """Channel 2 counts if it is cheaper by more than 1 %."""
    return true(F.col("diff_2") < 0) & ~true(F.abs("pct_2") <= 1)


def valid_3() -> Column:
    """Channel 3 counts if it is cheaper, by more than 10 % where it names no quantity."""
    return true(F.col("diff_3") < 0) & ~(F.col("qty_3").isNull() & true(F.abs("pct_3") <= 10))


def null_unless(df: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """Null every column of a channel's group where the channel does not count."""
    return df.withColumns({c: F.when(keep[g], F.col(c)) for g, cols in GROUPS.items() for c in cols if c in df.columns})


def second_stage(df: DataFrame) -> DataFrame:
    """Rows with a channel that counts; the other channel's columns nulled."""
    flagged = df.withColumn("ok_2", valid_2()).withColumn("ok_3", valid_3()).filter("ok_2 OR ok_3")
    return null_unless(flagged, {"2": F.col("ok_2"), "3": F.col("ok_3")}).drop("ok_2", "ok_3")


def second_stage_strict(df: DataFrame) -> DataFrame:
    """Row form: drop weak rows of either channel and rows with any higher price."""
    weak_3 = F.col("qty_3").isNull() & true(F.abs("pct_3") <= 10)
    weak_2 = true(F.abs("pct_2") <= 1)
    dearer = true(F.col("diff_2") > 0) | true(F.col("diff_3") > 0)
    return df.filter(undercut()).filter(~weak_3).filter(~weak_2).filter(~dearer).filter(undercut())


def second_stage_cells(df: DataFrame, promo: Column) -> DataFrame:
    """Cell form: null a channel that is not cheaper enough, then drop rows left empty.

    promo tells sellers of promotional goods, whom channel 3 keeps without a quantity. A
    quantity of channel 2 that is no number becomes null; a row is empty if no column of
    either channel is left, the seller's among them.
    """
    df = df.withColumn("qty_2", F.col("qty_2").cast("string").try_cast("double"))
    out_2 = true(F.col("diff_2") >= 0) | true(F.col("pct_2") > -1)
    out_3 = true(F.col("diff_3") >= 0) | true(F.col("pct_3") > -1)
    out_3 = out_3 | (F.col("qty_3").isNull() & true(F.col("pct_3") > -10) & ~true(promo))
    cells = [F.col(c).isNotNull() for cols in GROUPS.values() for c in cols if c in df.columns]
    return null_unless(df, {"2": ~out_2, "3": ~out_3}).filter(reduce(or_, cells))


def reference_price(df: DataFrame, price: str, candidate: str) -> DataFrame:
    """Priced candidates that are cheaper or at least 10 % dearer than the reference; all of
    them where there is no reference price above 0."""
    none = F.coalesce(F.col(price), F.lit(0.0)) <= 0
    pct = F.try_divide(F.col(candidate) - F.col(price), F.col(price)) * 100
    return df.filter((F.col(candidate) > 0) & (none | (pct < 0) | (pct >= 10)))


# Status texts.
NO_MATCH, EXTRACTION_FAILED, NO_IMAGE = "No Match Found (매칭 없음)", "Extraction Failed (데이터 수집 오류)", "Image Not Found (이미지 없음)"
NO_NAME, NO_PRODUCT, LOW_TEXT = "상품명 정보 없음", "동일상품 없음", "텍스트 유사도 낮음"


def match_status(text: Column, offer: Column, status: Column, low: int, high: int, least: float = 0.75) -> Column:
    """OK, or what is wrong with a match, the findings joined by a slash."""
    similar = F.when(text < least, F.concat(F.lit("Low Similarity ("), F.format_string("%.2f", text), F.lit(f" < {least})")))
    range_ = F.when((offer < low) | (offer > high), f"Price Out of Range ({low}~{high})")
    image = F.when(status == "Image Not Found", NO_IMAGE)
    found = F.array_join(F.array_compact(F.array(image, range_, similar)), " / ")
    return (
        F.when(offer.isNull(), NO_MATCH)
        .when(status == "Extraction Failed", EXTRACTION_FAILED)
        .otherwise(F.coalesce(F.nullif(found, F.lit("")), F.lit("OK")))
    )


def enrich_status(name: Column, price: Column, status: Column, similarity: Column, least: float = 0.6) -> Column:
    """Status of a channel's product: blank name, none found, too unlike, else its own."""
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", NO_NAME)
        .when(price.isNull(), NO_PRODUCT)
        .when(true(similarity < least), LOW_TEXT)
        .otherwise(status)
    )


def issue_class(pct: Column, stock: Column, expected: Column, limit: float = 10.0) -> Column:
    price, wrong = true(F.abs(pct) > limit), true(stock != expected)
    return F.when(price & wrong, "both").when(price, "price").when(wrong, "stock").otherwise("normal")


def keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The first row of each key by seq; ties by nothing else, so seq should be unique."""
    order = Window.partitionBy(key).orderBy(seq)
    return df.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


# Columns of the first-stage sheet and their names in the upload sheet, in its order.
UPLOAD_NAMES = {
    "구분": "구분(A/P)", "담당자": "담당자", "업체명": "공급사명", "업체코드": "공급처코드", "상품Code": "상품코드",
    "중분류카테고리": "카테고리(중분류)", "상품명": "상품명", "기본수량(1)": "본사 기본수량", "판매단가(V포함)": "판매단가1(VAT포함)", "본사상품링크": "본사링크",
    "기본수량(2)": "고려 기본수량", "판매단가(V포함)(2)": "판매단가2(VAT포함)", "가격차이(2)": "고려 가격차이", "가격차이(2)%": "고려 가격차이(%)", "고려기프트 상품링크": "고려 링크",
    "기본수량(3)": "네이버 기본수량", "판매단가(V포함)(3)": "판매단가3(VAT포함)", "가격차이(3)": "네이버 가격차이", "가격차이(3)%": "네이버가격차이(%)",
    "공급사명": "네이버 공급사명", "네이버 쇼핑 링크": "네이버 링크",
    "본사 이미지": "본사(이미지링크)", "고려기프트 이미지": "고려기프트(이미지링크)", "네이버 이미지": "네이버쇼핑(이미지링크)",
}
IMAGE_COLUMNS = ("본사 이미지", "고려기프트 이미지", "네이버 이미지")


def upload_sheet(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """The upload sheet of a first-stage sheet: the columns that it has, renamed, in the upload's order.

    Image cells that are formulas become their address; 'nan' and 'None' in them vanish. A house
    that heads its own images by another name passes its own ``names``.
    """
    names = names or UPLOAD_NAMES

    def cell(c: str) -> Column:
        if c not in IMAGE_COLUMNS:
            return F.col(f"`{c}`")
        link = F.regexp_replace(F.col(f"`{c}`").cast("string"), r'=IMAGE\("(.+)",\s*\d+\)', "$1")
        return F.regexp_replace(F.coalesce(link, F.lit("")), "nan|None", "")

    return df.select(*[cell(c).alias(n) for c, n in names.items() if c in df.columns])
