"""Column functions on page text: fields, links, tiers and tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareweave.functions.money import VAT, VAT_NAMED, clean_quantity, vat_gross_up
from wareweave.functions.urls import shown_image

#: Headings of a tier table: quantities, and prices for members only.
QUANTITY, MEMBER = "수량", "회원"


def fields(html: Column, patterns: dict[str, str]) -> list[Column]:
    """An extractor: one column per field, group 1 of its pattern or null."""
    return [F.nullif(F.regexp_extract(html, p, 1), F.lit("")).alias(name) for name, p in patterns.items()]


def attribute_values(html: Column, attribute: str) -> Column:
    """Values of an attribute in page order."""
    return F.regexp_extract_all(html, F.lit(rf'\b{attribute}="([^"]*)"'), 1)


def page_flags(text: Column) -> dict[str, Column]:
    """Whether a page says it is sold out, names the tax, and its product code or null."""
    code = F.regexp_extract(text, r"(?i)(?:product code|item no|상품코드|상품번호)\s*[:：]?\s*([A-Za-z0-9-]+)", 1)
    return {
        "sold_out": F.lower(text).rlike("sold out|품절"),
        "vat_named": text.rlike(VAT_NAMED),
        "code": F.nullif(code, F.lit("")),
    }


def image_links(html: Column) -> Column:
    """Distinct image addresses of <img src> and of style url(...), without interface images."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)<img\b[^>]*?\bsrc=["']([^"']+)["']"""), 1)
    styles = F.regexp_extract_all(html, F.lit(r"""(?i)url\(['"]?([^'"()]+)['"]?\)"""), 1)
    return F.array_distinct(F.filter(F.concat(tags, styles), shown_image))


def priced_tiers(text: Column) -> Column:
    """Array of (qty, price) of "N개: P원" by quantity; whole prices, tax added unless the text names it."""
    pattern = r"(\d+)개[:\s]+([0-9,]+)원"
    qty = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: x.cast("int"))
    price = F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), lambda x: vat_gross_up(F.replace(x, F.lit(","), F.lit("")).cast("double"), text).cast("long"))
    return F.array_sort(F.zip_with(qty, price, lambda q, p: F.struct(q.alias("qty"), p.alias("price"))))


def option_tiers(text: Column, base: Column) -> Column:
    """Array of (qty, price, unit_price) of "qty:+delta" options on a base price."""
    options = F.split(text, ";")
    qty = lambda o: F.split_part(o, F.lit(":"), F.lit(1)).try_cast("int")
    price = lambda o: base + F.split_part(o, F.lit(":"), F.lit(2)).try_cast("double")
    return F.transform(options, lambda o: F.struct(qty(o).alias("qty"), price(o).alias("price"), (price(o) / qty(o)).alias("unit_price")))


def transpose_tiers(rows: Column) -> Column:
    """A table of few rows (quantities across, prices below) as (qty, price) by quantity, tax added.

    rows is an array of rows, each an array of cells with its heading first. The row of
    the quantity's heading gives the quantities, cleaned; the first row that is neither it
    nor the members' prices gives the prices.
    """
    headed = lambda name: F.get(F.filter(rows, lambda r: r[0] == name), F.lit(0))
    prices = F.get(F.filter(rows, lambda r: ~r[0].isin(QUANTITY, MEMBER)), F.lit(0))
    cells = lambda row: F.slice(row, 2, F.greatest(F.size(row) - 1, F.lit(0)))
    price = lambda p: F.regexp_replace(p, r"[^\d.]", "").try_cast("double") * VAT
    pairs = F.zip_with(cells(headed(QUANTITY)), cells(prices), lambda q, p: F.struct(clean_quantity(q).alias("qty"), price(p).alias("price")))
    return F.array_sort(F.filter(pairs, lambda t: t["qty"].isNotNull() & t["price"].isNotNull()))


def spec_map(html: Column) -> Column:
    """Header cells to data cells of a table; of a repeated header the last cell, none without a header."""
    cell = lambda tag: F.regexp_extract_all(html, F.lit(f"<{tag}>([^<]*)</{tag}>"), 1)
    pairs = F.zip_with(cell("th"), cell("td"), lambda a, b: F.struct(a.alias("key"), b.alias("value")))
    named = F.filter(pairs, lambda p: p["key"].isNotNull())
    last = F.filter(named, lambda p, i: F.array_position(F.slice(F.transform(named, lambda q: q["key"]), i + 2, F.size(named)), p["key"]) == 0)
    return F.map_from_entries(last)


def first_layout(*layouts: Column) -> Column:
    """The first layout that yields rows."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in layouts])
