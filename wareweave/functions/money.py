"""Column functions on prices, quantities and price differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no number" in a sheet, and error cells.
NOT_NUMBERS = ("#REF!", "", "-", "동일상품 없음", "(공백)", "(공백 or 없음)", "가격이 범위 내에 없거나 검색된 상품이 없음")
ERROR_CELLS = ("#N/A", "#NULL", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?")
VAT = 1.1
# Wording about the tax; the first also holds "separate" and "excluded".
VAT_NAMED = r"(?i)VAT\s*(포함|별도|제외)"
VAT_INCLUDED = r"(?i)vat 포함|vat included"


def to_numeric(c: Column) -> Column:
    """A number, or null for placeholders and anything that is none."""
    text = F.replace(c, F.lit(","), F.lit(""))
    return F.when(~c.isin(*NOT_NUMBERS), text.try_cast("double"))


def clean_price(c: Column, low: float, high: float, clamp: bool = True) -> Column:
    """Digits and point of the text as a price within [low, high].

    Null and digits that are no number (1.2.3) give 0; a text without digits counts as 0
    and goes to the nearer bound like any number outside, or to 0 without clamp.
    """
    digits = F.regexp_replace(c, r"[^\d.]", "")
    value = F.when(digits == "", 0.0).otherwise(digits.try_cast("double"))
    outside = F.least(F.greatest(value, F.lit(low)), F.lit(high)) if clamp else F.lit(0.0)
    return F.when(value.isNull(), 0.0).when(value.between(low, high), value).otherwise(outside)


def first_number(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, r"([\d,]*\d[\d,]*)", 1), F.lit(","), F.lit("")).try_cast("long")


def first_quantity(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)(개|세트|묶음)", 1).try_cast("int")


def vat_gross_up(price: Column, text: Column, strict: bool = False) -> Column:
    """Add the tax unless the text names it; strict: unless the text says it is included."""
    named = F.coalesce(text.rlike(VAT_INCLUDED if strict else VAT_NAMED), F.lit(False))
    return F.when(named, price).otherwise(price * VAT)


def clean_quantity(c: Column) -> Column:
    """Digits of a quantity; "below N" is N-1, at least 0; the word for thousand is 000."""
    digits = F.regexp_replace(F.replace(c, F.lit("천부"), F.lit("000")), r"[^\d]", "").try_cast("int")
    return F.when(c.contains("미만"), F.greatest(digits - 1, F.lit(0))).otherwise(digits)


def price_diff(source: Column, candidate: Column) -> Column:
    """candidate - source; 0 where either is 0 or unknown."""
    known = (source > 0) & (candidate != 0)
    return F.when(F.coalesce(known, F.lit(False)), candidate - source).otherwise(F.lit(0.0))


def price_diff_pct(source: Column, candidate: Column) -> Column:
    known = (source > 0) & (candidate != 0)
    return F.when(F.coalesce(known, F.lit(False)), (candidate - source) / source * 100).otherwise(F.lit(0.0))


def price_similarity(source: Column, candidate: Column, least: float = 0.15, weight: float = 0.2) -> Column:
    """Closeness of two prices, weighed; 0 below the least closeness."""
    close = 1 - F.abs(source - candidate) / F.greatest(source, candidate)
    return F.when(F.greatest(source, candidate) > 0, F.when(close >= least, close * weight).otherwise(0.0)).otherwise(0.0)


def prices_compatible(a: Column, b: Column, low: float, high: float, most: float = 0.3) -> Column:
    """Both in range, and either not positive or at most ``most`` apart; null counts as 0."""
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    near = (a <= 0) | (b <= 0) | (F.try_divide(F.abs(a - b), F.greatest(a, b)) <= most)
    return a.between(low, high) & b.between(low, high) & near
