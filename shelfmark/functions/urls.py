"""URL helpers. All but ``normalize_url`` are native expressions, usable inside lambdas."""

from __future__ import annotations

from urllib.parse import quote, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from shelfmark.functions.base import let
from shelfmark.functions.text import SPACE, strip

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_PREFIX = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"

# Front controllers that may lead a path.
FRONT_CONTROLLERS = ["index.php", "index.html", "index.htm", "index.asp", "index.aspx"]
# Catalogue index names.
ARCHIVE_ROOTS = ["shop", "store", "products", "catalogue", "catalog"]
# Path tokens of product pages.
PRODUCT_HINTS = [
    "/product/", "/produkt/", "/products/", "/item/", "/p/", "/catalogue/", "/catalog/",
    "/product-detail/", "/pd/", "/dp/", "/buy/",
]
# Tokens of listing pages.
LISTING_HINTS = [
    "/page/", "paged=", "product-category", "/category/", "/categories", "route=product/category",
    "/collections/", "/shop", "/store", "/catalog", "/departments/", "/brand",
]
# File suffixes that are assets and not pages.
ASSET_SUFFIXES = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".svg", ".ico", ".pdf", ".zip", ".mp4",
    ".webm", ".mp3", ".css", ".js", ".xml",
]
# Path tokens of pages that hold no product.
NON_PRODUCT_TOKENS = [
    "/blog/", "/news/", "/author/", "/tag/", "/category/", "/page/", "/cart", "/checkout",
    "/my-account", "/wishlist", "/contact", "/about", "/privacy", "/terms", "/faq", "/wp-content/",
    "/wp-json/", "/feed",
]
# Tokens of images that are furniture.
JUNK_IMAGE_TOKENS = [
    "placeholder", "spacer", "blank.gif", "loading.gif", "lazy.gif", "woocommerce-placeholder",
    "/loader", "transparent.png", "data:image", "sprite", "/flags/", "payment", "trustbadge",
]


def any_of(tokens: list) -> str:
    """One regular expression that finds any of the literal tokens."""
    special = set(r".^$*+?()[]{}|\/-")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in t) for t in tokens)


def netloc(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PREFIX + r"//([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    return F.lower(netloc(url))


def url_path(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), _PREFIX + r"(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def _with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def base_url(url: Column) -> Column:
    """Scheme and host of a store address, ``https`` when none is given."""
    full = _with_scheme(url)
    scheme = F.lower(F.regexp_extract(full, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
    host = F.coalesce(
        F.nullif(netloc(full), F.lit("")), F.element_at(F.split(url_path(full), "/"), 1)
    )
    return F.concat(F.coalesce(F.nullif(scheme, F.lit("")), F.lit("https")), F.lit("://"), host)


def store_host(url: Column) -> Column:
    """Host of a store address without user info and a leading ``www.``."""
    full = _with_scheme(url)
    host = F.coalesce(F.nullif(netloc(full), F.lit("")), url_path(full))
    host = F.element_at(F.split(F.element_at(F.split(F.lower(host), "/"), 1), "@"), -1)
    return F.regexp_replace(host, r"^www\.", "")


def site_name(url: Column) -> Column:
    """The folder name of a store."""
    name = F.regexp_replace(store_host(url), r"[^a-z0-9.\-]", "_")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown-site"))


def _meaningful(path: Column) -> Column:
    """A path less any leading front controllers."""
    return F.regexp_replace(path, rf"(?i)^/*(?:(?:{any_of(FRONT_CONTROLLERS)})(?:/+|$))+", "/")


def page_segments(path: Column) -> Column:
    """Non-empty path parts, less any leading front controllers."""
    return F.filter(F.split(_meaningful(path), "/"), lambda s: s != "")


def first_segment_key(url: Column) -> Column:
    """``/<first path part>/``, the shape key of a URL; ``/`` for a root."""
    first = F.regexp_extract(url_path(url), r"^/*([^/]+)", 1)
    return F.when(first == "", F.lit("/")).otherwise(F.concat(F.lit("/"), first, F.lit("/")))


def is_archive_root(url: Column) -> Column:
    """The site root, or a catalogue index."""
    return _meaningful(url_path(url)).rlike(f"(?i)^/*(?:{'|'.join(ARCHIVE_ROOTS)})?/*$")


def is_scrapable_page(url: Column, host: Column | None = None) -> Column:
    """True for a page address that may hold a product, on ``host`` when one is given.

    Three patterns on the path, so that the test stays inside generated code: assets and pages
    of another kind; then roots, catalogue indexes and single parts of up to three characters.
    """
    url = F.coalesce(url, F.lit(""))
    path = F.lower(url_path(url))
    unwanted = f"(?:{any_of(ASSET_SUFFIXES)})$|{any_of(NON_PRODUCT_TOKENS)}"
    empty = f"^/*(?:[^/]{{1,3}}|{'|'.join(ARCHIVE_ROOTS)})?/*$"
    ok = url.rlike("^https?://") & ~path.rlike(unwanted) & ~_meaningful(path).rlike(empty)
    return ok if host is None else ok & (F.coalesce(host, F.lit("")).isin("") | (host_of(url) == host))


def has_product_hint(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike(any_of(PRODUCT_HINTS))


def looks_like_listing(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike(any_of(LISTING_HINTS))


def is_junk_image(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return (low == "") | low.rlike(any_of(JUNK_IMAGE_TOKENS))


def _tidy_path(parts: Column) -> Column:
    """Resolve ``.`` and ``..`` parts."""
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    open_end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    joined = F.array_join(F.concat(kept, open_end), "/")
    return F.regexp_replace(joined, "^(?!/)", "/")


def resolve_url(href: Column, base: Column) -> Column:
    """Resolve a reference against the page it stands on."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    root = F.concat(scheme, F.lit("://"), netloc(base))
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    base_parts = F.split(url_path(base), "/")
    # A relative path hangs under the folder of the base; empty middle parts collapse.
    below = F.concat(F.slice(base_parts, 1, F.greatest(F.size(base_parts) - 1, F.lit(1))), F.split(path, "/"))
    size = F.size(below)
    relative = F.filter(below, lambda p, i: (p != "") | (i == 0) | (i == size - 1))
    parts = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)
    base_query = F.regexp_extract(base, r"^[^#]*", 0)
    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(
            path == "",
            F.when(tail.startswith("?"), F.concat(root, url_path(base), tail)).otherwise(
                F.concat(base_query, tail)
            ),
        )
        .otherwise(F.concat(root, _tidy_path(parts), tail))
    )


def absolutize_url(url: Column, base: Column) -> Column:
    """Absolute form of an image or link address; data URIs become empty."""

    def choose(url):
        return (
            F.when(url == "", F.lit(""))
            .when(url.startswith("//"), F.concat(F.lit("https:"), url))
            .when(url.rlike("^https?://"), url)
            .when(url.startswith("data:"), F.lit(""))
            .otherwise(resolve_url(url, base))
        )

    return let(strip(F.coalesce(url, F.lit(""))), choose)


def html_cache_key(url: Column) -> Column:
    return F.sha1(F.coalesce(url, F.lit("")))


def largest_from_srcset(value: Column) -> Column:
    """The candidate with the largest width or density; the first one on ties."""
    candidates = F.filter(
        F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip), lambda c: c != ""
    )

    def scored(candidate, position):
        parts = F.split(candidate, f"(?U){SPACE}+")
        size = F.lower(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1x")))
        number = F.regexp_extract(size, r"^(.*)[wx]$", 1).try_cast("double")
        return F.struct(
            F.coalesce(number, F.lit(1.0)).alias("score"),
            (-position).alias("first"),
            F.element_at(parts, 1).alias("url"),
        )

    best = F.array_max(F.filter(F.transform(candidates, scored), lambda c: c.score > -1.0))
    return F.coalesce(best.getField("url"), F.lit(""))


def _quote_plus(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _unquote_plus(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def with_params(url: Column, params: Column) -> Column:
    """Merge a ``map<string,string>`` of parameters into the query of a URL."""
    parts = F.filter(F.split(url_query(url), "&"), lambda p: p != "")
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            _unquote_plus(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
            _unquote_plus(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)).alias("v"),
        ),
    )
    added = F.transform(
        F.map_entries(params), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))
    )
    every = F.concat(pairs, added)
    keys = F.array_distinct(F.transform(every, lambda e: e["k"]))
    merged = F.transform(
        keys,
        lambda k: F.concat(
            _quote_plus(k),
            F.lit("="),
            _quote_plus(F.element_at(F.filter(every, lambda e: e["k"] == k), -1)["v"]),
        ),
    )
    head = F.regexp_extract(url, r"^[^?#]*", 0)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(F.size(params) == 0, url).otherwise(
        F.concat(head, F.lit("?"), F.array_join(merged, "&"), fragment)
    )


def _normalize(url):
    if not url:
        return url
    try:
        parts = urlparse(url.strip())
        host = parts.netloc if parts.netloc.isascii() else parts.netloc.encode("idna").decode("ascii")
        return urlunparse(
            parts._replace(
                netloc=host,
                path=quote(parts.path, safe="/%:@&=+$,~!*'()"),
                params=quote(parts.params, safe="/%:@&=+$,~"),
                query=quote(parts.query, safe="/%:@&=+$,~?"),
            )
        )
    except (UnicodeError, ValueError):
        return url


@F.pandas_udf(T.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    """Percent-encode path and query and write the host in its ASCII form."""
    return urls.map(_normalize, na_action="ignore")
