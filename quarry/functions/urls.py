"""URLs as column expressions: parts by regular expression, so malformed ones give nulls and not errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
# The path endings that are not crawled.
EXCLUDED_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".tar", ".gz", ".7z",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv",
    ".css", ".js", ".json", ".xml",
]
EXCLUDED = r"\.(" + "|".join(e[1:] for e in EXCLUDED_EXTENSIONS) + ")$"
# What an image's address holds, and what it must not hold.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp"]
IMAGE_NOT = ["icon", "logo", "favicon", "sprite", "pixel"]


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    """Without the parameters of its last segment."""
    return F.regexp_replace(_part(url, 3), ";[^/]*$", "")


def normalise(url: Column) -> Column:
    """Scheme in lower case, no fragment, no parameters, no slashes at the end."""
    query = _part(url, 4)
    query = F.when(F.length(query) > 1, query).otherwise("")
    return F.regexp_replace(F.concat(scheme(url), F.lit("://"), host(url), path(url), query), "/+$", "")


def is_valid(url: Column, allowed_domains: tuple[str, ...] = ()) -> Column:
    ok = scheme(url).isin("http", "https") & (host(url) != "") & ~F.lower(path(url)).rlike(EXCLUDED)
    if allowed_domains:
        ok &= F.exists(F.array(*map(F.lit, allowed_domains)), lambda d: F.contains(F.lower(host(url)), d))
    return F.coalesce(ok, F.lit(False))


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL from a link; dot segments are kept as they are."""
    root = F.concat(scheme(base), F.lit("://"), host(base))
    folder = F.regexp_replace(_part(base, 3), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(root, _part(base, 3), href))
        .when((href == "") | href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, folder, href))
    )


def is_image(url: Column) -> Column:
    """Holds an image extension anywhere, and none of the names that icons and counters have."""
    low = F.lower(url)
    return low.rlike(r"\.(" + "|".join(e[1:] for e in IMAGE_EXTENSIONS) + ")") & ~low.rlike("|".join(IMAGE_NOT))
