"""Column functions on URLs and image references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_END = r"(?i)\.(jpe?g|png|gif|webp|bmp)([?#].*)?$"
# Words for "no image", parts of user-interface image names, and parts of
# an address that speak for an image.
NO_IMAGE = ("없음", "none", "null", "na", "-")
UI_PARTS = r"(?i)(icon|button|btn|bg_|pixel\.gif|blank\.gif|spacer\.gif)"
SHOP_UI_PARTS = (
    "btn_", "icon_", "dot_", "bottom_", "/bbs/image/", "guide1.jpg", "s1.png",
    "/common/", "/layout/", "/banner/", ".gif",
)
IMAGE_PARTS = r"(?i)(image|img|photo|picture|thumbnail|thumb)"
IMAGE_HOSTS = (
    "img.danawa.com", "shopping-phinf.pstatic.net", "image.gmarket.co.kr",
    "image.auction.co.kr", "thumbnail.image.rakuten.co.jp", "cdn.pixabay.com", "images.unsplash.com",
)


def clean_url(c: Column) -> Column:
    """A sheet's URL with a scheme, or ''."""
    text = F.trim(c)
    whole = F.when(text.rlike(r"^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(text.isNull() | text.isin("", "nan"), "").otherwise(whole)


def unwrap_image(c: Column) -> Column:
    """The URL inside =IMAGE("url", n), else the text itself."""
    inner = F.regexp_extract(c, r'^=IMAGE\("([^"]*)"', 1)
    return F.when(c.startswith("=IMAGE("), inner).otherwise(c)


def image_formula(c: Column, size: int = 2) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").otherwise(F.concat(F.lit('=IMAGE("'), c, F.lit(f'", {size})')))


def clean_image_url(c: Column) -> Column:
    """Unwrap, strip quotes, drop words for none, add a scheme."""
    text = F.trim(F.translate(unwrap_image(c), "\"'", ""))
    scheme = F.when(text.rlike(r"(?i)^https?://"), text).when(text.startswith("//"), F.concat(F.lit("https:"), text))
    return F.when(text.isNull() | (text == "") | F.lower(text).isin(*NO_IMAGE), "").otherwise(
        F.coalesce(scheme, F.concat(F.lit("https://"), text))
    )


def _holds(c: Column, parts: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(p.replace(".", "[.]") for p in parts))


def likely_image(c: Column, hosts: tuple[str, ...] = IMAGE_HOSTS) -> Column:
    """An image file's ending, an image host, or a part that speaks for an image."""
    return F.coalesce(c.rlike(IMAGE_END) | _holds(c, hosts) | c.rlike(IMAGE_PARTS), F.lit(False))


def shown_image(c: Column) -> Column:
    """A product image: an image file that is no part of a page's interface."""
    return F.coalesce(c.rlike(IMAGE_END), F.lit(False)) & ~F.coalesce(c.rlike(UI_PARTS), F.lit(False))


def shop_ui_image(c: Column, parts: tuple[str, ...] = SHOP_UI_PARTS) -> Column:
    """An image that belongs to a shop page's interface."""
    return F.coalesce(_holds(c, parts), F.lit(False))


def normalize_url(c: Column) -> Column:
    """No @, https, forward slashes, quotes and spaces encoded."""
    text = F.translate(F.trim(c), "@", "")
    text = F.when(text.startswith("http:"), F.concat(F.lit("https:"), F.substr(text, F.lit(6)))).when(
        text.startswith("//"), F.concat(F.lit("https:"), text)
    ).when(~text.rlike(r"^[a-z]+:") & text.contains("."), F.concat(F.lit("https://"), text)).otherwise(text)
    return F.replace(F.replace(F.translate(text, "\\", "/"), F.lit('"'), F.lit("%22")), F.lit(" "), F.lit("%20"))


def absolute_url(base: Column, link: Column) -> Column:
    """Join a link to its page's URL and drop the fragment."""
    scheme, host = F.regexp_extract(base, r"^([a-z]+):", 1), F.regexp_extract(base, r"^[a-z]+://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_extract(base, r"^[^?#]*", 0), r"^[a-z]+://[^/]*(?:/.*)?/|^[a-z]+://[^/]*", 0)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    joined = (
        F.when(link.rlike(r"^[a-z]+://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(host, link))
        .otherwise(F.concat(folder, link))
    )
    return F.regexp_extract(joined, r"^[^#]*", 0)


def url_id(c: Column, key: str) -> Column:
    """A numeric query parameter of the URL, else the MD5 of the URL."""
    value = F.regexp_extract(c, rf"[?&]{key}=(\d+)", 1)
    return F.coalesce(F.nullif(value, F.lit("")), F.md5(c.cast("binary")))


def pick_image(gallery: Column, placeholder: str) -> Column:
    """The first gallery image that is no .png, else the placeholder."""
    return F.coalesce(F.get(F.filter(gallery, lambda u: ~F.lower(u).endswith(".png")), F.lit(0)), F.lit(placeholder))


def pick_status(gallery: Column) -> Column:
    """The status that goes with pick_image: whether the placeholder had to stand in."""
    found = F.coalesce(F.exists(gallery, lambda u: ~F.lower(u).endswith(".png")), F.lit(False))
    return F.when(found, "OK").otherwise("Image Not Found")


def repair_image(c: Column, host: str, key: Column, empty: tuple[str, ...] = ()) -> Column:
    """An absolute image URL; a missing one, or one of the stand-ins, becomes the host's file of the key."""
    text = F.coalesce(F.trim(c), F.lit(""))
    own = F.concat(F.lit(f"{host}/shop_"), key.cast("string"), F.lit("_0.jpg"))
    whole = (
        F.when(text.rlike(r"(?i)^https?://"), text)
        .when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(text.startswith("/"), F.concat(F.lit(host), text))
        .otherwise(F.concat(F.lit(f"{host}/"), text))
    )
    return F.when((text == "") | text.isin(*empty), own).otherwise(whole)


def repair_gallery(gallery: Column, host: str, key: Column) -> Column:
    """repair_image of every image."""
    return F.transform(gallery, lambda u: repair_image(u, host, key))


def gallery_text(gallery: Column, most: int = 5) -> Column:
    return F.array_join(F.slice(gallery, 1, most), " | ")
