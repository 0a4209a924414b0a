"""Finding product URLs: sitemaps, platform APIs, links, and the shape of a site's URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.base import let
from shelfmark.functions.text import strip, unescape_all
from shelfmark.functions.urls import (
    PRODUCT_HINTS, any_of, first_segment_key, has_product_hint, host_of, is_scrapable_page,
    looks_like_listing, resolve_url,
)
from shelfmark.operators.elements import element_array, rule_ids
from shelfmark.operators.rules import PLATFORM_RULES, SELECTORS
from shelfmark.runtime import cut_lineage, with_global_index

# Sitemap names that hold products, or taxonomies.
PRODUCT_SITEMAP_HINTS = ["product", "produkt"]
TAXONOMY_SITEMAP_HINTS = [
    "product_cat", "product-cat", "product_tag", "product-tag", "category", "categories",
    "product_brand", "product-brand", "brand", "tag", "pa_", "attribute",
]
# Where sitemaps are looked for when robots.txt names none.
SITEMAP_FALLBACK_PATHS = [
    "/sitemap_index.xml", "/sitemap.xml", "/wp-sitemap.xml", "/product-sitemap.xml",
    "/sitemap.xml.gz", "/sitemap_products_1.xml", "/pub/sitemap.xml", "/sitemap/sitemap.xml",
]
# Where a listing crawl starts.
CRAWL_SEEDS = [
    "/", "/shop/", "/store/", "/products/", "/catalogue/", "/catalog/", "/categories",
    "/product-category/",
]
MIN_PAGES, MIN_KNOWN, MIN_DOMINANT, DOMINANT_SHARE = 5, 5, 20, 0.66


# ── Sitemaps and robots ───────────────────────────────────────────────────


_COMMENT = r"(?s)<!--.*?-->"
_REFERENCE = r"(?i)&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|lt|gt|quot|apos|amp);|[^&]+|&"


def xml_text(text: Column) -> Column:
    """Character references of XML decoded, each once; those to no character stay as they are."""

    def decoded(part):
        digits = F.regexp_extract(part, "^&#(x?[0-9a-fA-F]+);$", 1)
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).try_cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        named = F.lower(part)
        plain = F.when(named == "&lt;", "<").when(named == "&gt;", ">").when(named == "&quot;", '"').when(
            named == "&apos;", "'").when(named == "&amp;", "&").otherwise(part)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(plain)

    parts = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(~text.contains("&"), text).otherwise(F.array_join(F.transform(parts, decoded), ""))


_NAME = r"[A-Za-z_][\w.-]*"


def _sitemap_prefixes(bare: Column) -> Column:
    """Prefixes that the root element binds to its own namespace, with their colon; '' for the default one.

    A document that binds none has the root's prefix and plain tags.
    """
    root = F.regexp_extract(bare, rf"<({_NAME}(?::{_NAME})?(?:\s[^>]*)?)>", 1)
    own = F.regexp_extract(root, rf"^({_NAME}):", 1)
    binding = rf"(?s)\sxmlns(?::({_NAME}))?\s*=\s*[\"']([^\"']*)[\"']"
    names, spaces = (F.regexp_extract_all(root, F.lit(binding), F.lit(k)) for k in (1, 2))
    bound = F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("name"), spaces.alias("space"))))
    space = F.try_element_at(bound, own)
    same = F.map_keys(F.map_filter(bound, lambda k, v: v == space))
    plain = F.when(F.array_contains(names, ""), F.array().cast("array<string>")).otherwise(F.array(F.lit("")))
    prefixes = F.when(space.isNull(), F.array(own, F.lit(""))).otherwise(F.concat(same, plain))
    return F.transform(prefixes, lambda p: F.when(p == "", "").otherwise(F.concat(p, F.lit(":"))))


def sitemap_locations(xml: Column) -> Column:
    """Trimmed, non-empty values of the ``loc`` tags of one document, in document order.

    A prefix counts as the root element binds it: ``<sm:loc>`` is a location where ``sm`` is the
    root's own namespace, ``<image:loc>`` of another one is a picture and no page address.
    """
    bare = F.regexp_replace(F.coalesce(xml, F.lit("")), _COMMENT, "")
    found = rf"(?is)<((?:{_NAME}:)?)loc(?:\s[^>]*)?>\s*(.*?)\s*</\1loc\s*>"
    pairs = F.arrays_zip(*[F.regexp_extract_all(bare, F.lit(found), F.lit(k)).alias(n) for k, n in ((1, "prefix"), (2, "text"))])
    raw = let(_sitemap_prefixes(bare), lambda known: F.transform(F.filter(pairs, lambda x: F.array_contains(known, x["prefix"])), lambda x: x["text"]))

    def value(loc):
        quoted = F.regexp_extract(loc, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
        return strip(F.when(loc.startswith("<![CDATA["), quoted).otherwise(xml_text(loc)))

    return F.filter(F.transform(raw, value), lambda u: u != "")


def parse_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """One row per location: the input columns less ``xml``, plus ``(pos, loc)``."""
    carried = [c for c in sitemaps.columns if c != "xml"]
    return sitemaps.select(*carried, F.posexplode(sitemap_locations(F.col("xml"))).alias("pos", "loc"))


def is_sitemap_index(xml: Column) -> Column:
    """True where the root element is a sitemap index, whatever comments stand before it."""
    bare = F.regexp_replace(F.coalesce(xml, F.lit("")), _COMMENT, "")
    root = F.regexp_extract(bare, r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)", 1)
    return F.lower(root) == "sitemapindex"


def is_product_sitemap(url: Column) -> Column:
    name = F.lower(F.coalesce(url, F.lit("")))
    return name.rlike(any_of(PRODUCT_SITEMAP_HINTS)) & ~name.rlike(any_of(TAXONOMY_SITEMAP_HINTS))


def classify_sitemaps(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.withColumn("is_index", is_sitemap_index(F.col("xml"))).withColumn(
        "is_product", ~F.col("is_index") & is_product_sitemap(F.col("sitemap_url"))
    )


def robots_sitemaps(body: Column) -> Column:
    """Addresses of the ``sitemap:`` lines of a robots.txt, in order."""
    lines = F.filter(
        F.split(F.coalesce(body, F.lit("")), r"\R"), lambda l: F.lower(strip(l)).startswith("sitemap:")
    )
    return F.filter(
        F.transform(lines, lambda l: strip(F.regexp_extract(l, r"^[^:]*:(.*)$", 1))), lambda u: u != ""
    )


def parse_robots(robots: DataFrame) -> DataFrame:
    return robots.select("site", F.posexplode(robots_sitemaps(F.col("body"))).alias("pos", "sitemap_url"))


def sitemap_candidates(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """Per site: sitemaps named by robots.txt, then the usual places, without repeats.

    Of several bodies of a site the first in text order counts.
    """
    bodies = robots.groupBy("site").agg(F.min(F.nullif(F.col("body"), F.lit(""))).alias("body"))
    usual = F.transform(
        F.array(*[F.lit(p) for p in SITEMAP_FALLBACK_PATHS]), lambda p: F.concat(F.col("base"), p)
    )
    listed = F.array_distinct(F.concat(robots_sitemaps(F.col("body")), usual))
    return sites.join(bodies, "site", "left").select("site", F.posexplode(listed).alias("pos", "sitemap_url"))


def ranked_in_site(rows: DataFrame, order: list) -> DataFrame:
    """Add ``_rank``, 1-based within the site in ``order``. No site's rows meet in one task."""
    placed = with_global_index(rows, ["site", *order], "_index")
    starts = placed.groupBy("site").agg(F.min("_index").alias("_start"))
    return placed.join(starts, "site").withColumn("_rank", (F.col("_index") - F.col("_start") + 1).cast("int")).drop("_index", "_start")


def _within(ranked: DataFrame, limit: int | None) -> DataFrame:
    """What a site has left of ``limit`` after the ``_used`` rows before."""
    return ranked if limit is None else ranked.where(F.col("_rank") + F.coalesce("_used", F.lit(0)) <= limit)


def expand_sitemap_index(sitemaps: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Sitemaps reached from ``seeds(site, sitemap_url, pos)``, breadth first.

    Level by level: a level's rows are ordered as their parents queued them and looked up with an
    equi-join. The documents are parsed once and stored; each level is checkpointed. ``limit`` is
    a number of visits a site that a caller may state. Returns ``(site, sitemap_url, visit,
    found)``; ``found`` tells whether the document is in the table.
    """
    locations = sitemap_locations(F.col("xml"))
    documents = cut_lineage(sitemaps.select(
        "site", "sitemap_url", (F.size(locations) > 0).alias("filled"),
        F.when(is_sitemap_index(F.col("xml")), locations).alias("children"),
    ))
    level = seeds.groupBy("site", "sitemap_url").agg(F.min(F.struct("pos", F.lit(0).alias("i"))).alias("place"))
    visited = None
    while True:
        if visited is None:
            fresh = level.withColumn("_used", F.lit(0))
        else:
            used = visited.groupBy("site").agg(F.count(F.lit(1)).alias("_used"))
            fresh = level.join(visited, ["site", "sitemap_url"], "left_anti").join(used, "site", "left")
        taken = _within(ranked_in_site(fresh, ["place", "sitemap_url"]), limit)
        looked_up = cut_lineage(
            taken.join(documents, ["site", "sitemap_url"], "left").select(
                "site", "sitemap_url",
                (F.coalesce("_used", F.lit(0)) + F.col("_rank") - 1).cast("int").alias("visit"),
                F.coalesce("filled", F.lit(False)).alias("found"), "children",
            )
        )
        rows = looked_up.drop("children")
        visited = rows if visited is None else cut_lineage(visited.unionByName(rows))
        below = looked_up.where(F.size("children") > 0)
        if below.isEmpty():
            return visited
        level = (
            below.select("site", "visit", F.posexplode("children").alias("i", "sitemap_url"))
            .groupBy("site", "sitemap_url")
            .agg(F.min(F.struct(F.col("visit").alias("pos"), "i")).alias("place"))
        )


def infer_product_urls(urls: DataFrame) -> DataFrame:
    """Product URLs of a site by shape, from ``urls(site, host, url, pos)``.

    URLs are counted by first path part, the counts alone decide, and the choice (one row a
    site) is joined back.
    """
    pages = urls.where(is_scrapable_page(F.col("url"), F.col("host"))).withColumn(
        "_key", first_segment_key(F.col("url"))
    )
    groups = pages.groupBy("site", "_key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    known = F.col("_key").isin(PRODUCT_HINTS) & (F.col("n") >= MIN_KNOWN)
    largest = F.struct((-F.col("n")).alias("less"), F.col("first"))
    choice = groups.groupBy("site").agg(
        F.sum("n").alias("total"),
        F.min_by(F.when(known, F.col("_key")), F.when(known, F.col("first"))).alias("known"),
        F.min_by(F.struct("_key", "n"), largest).alias("largest"),
    )
    dominant = (
        (F.col("largest.n") / F.col("total") >= DOMINANT_SHARE)
        & (F.col("largest.n") >= MIN_DOMINANT)
        & (F.col("largest._key") != "/")
    )
    chosen = choice.where(F.col("total") >= MIN_PAGES).select(
        "site", F.coalesce("known", F.when(dominant, F.col("largest._key"))).alias("_key")
    )
    return pages.join(chosen.where("_key is not null"), ["site", "_key"], "left_semi").drop("_key")


def urls_from_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Product URLs of ``sitemaps(site, host, visit, sitemap_url, xml)``.

    Per site: the pages of product sitemaps; without any, pages with a product hint; without
    those, the dominant URL shape. Which of them applies is two flags a site. The documents are
    parsed once and their page URLs stored.
    """
    pages = cut_lineage(
        parse_sitemaps(classify_sitemaps(sitemaps).where(~F.col("is_index")))
        .where(is_scrapable_page(F.col("loc"), F.col("host")))
        .select(
            "site", "host", F.col("loc").alias("url"), F.struct("visit", F.col("pos")).alias("pos"),
            F.col("is_product").alias("_product"), has_product_hint(F.col("loc")).alias("_hint"),
        )
    )
    flags = pages.groupBy("site").agg(
        F.max("_product").alias("_any_product"), F.max("_hint").alias("_any_hint")
    )
    flagged = pages.join(flags, "site")
    direct = flagged.where(
        F.when(F.col("_any_product"), F.col("_product")).otherwise(F.col("_hint"))
    ).select("site", "url", "pos")
    flat = flagged.where(~F.col("_any_product") & ~F.col("_any_hint")).select("site", "host", "url", "pos")
    return direct.unionByName(infer_product_urls(flat).select("site", "url", "pos"))


# ── Platform APIs ─────────────────────────────────────────────────────────


def full_pages(api_pages: DataFrame, size: int, max_pages: int | None = None) -> DataFrame:
    """Pages from 1 up to and with the first short one or the last before a gap.

    ``n`` is the number of items of a page; ``max_pages`` is a limit that a caller may state. The
    stop is one row a site from aggregations, so no site's pages are gathered.
    """
    seen = api_pages if max_pages is None else api_pages.where(F.col("page") <= max_pages)
    places = seen.select("site", "page", "n")
    ends = places.join(places.select("site", (F.col("page") - 1).alias("page")).distinct(), ["site", "page"], "left_anti")
    gap = ends.groupBy("site").agg(F.min("page").alias("_gap"))
    short = places.groupBy("site").agg(
        F.min(F.when(F.col("n") < size, F.col("page"))).alias("_short"), F.min("page").alias("_first")
    )
    stop = gap.join(short, "site").where("_first = 1").select("site", F.least("_gap", "_short").alias("_stop"))
    return seen.join(stop, "site").where((F.col("page") <= F.col("_stop")) & (F.col("n") > 0)).drop("_stop")


def _urls_from_api(api_pages: DataFrame, items: Column, field: str, size: int, max_pages: int | None) -> DataFrame:
    listed = api_pages.select("site", "base", "page", items.alias("items")).withColumn(
        "n", F.coalesce(F.size("items"), F.lit(0))
    )
    kept = full_pages(listed, size, max_pages)
    return kept.select("site", "base", "page", F.posexplode("items").alias("pos", "item")).select(
        "site", "base", F.struct("page", "pos").alias("pos"), F.col(f"item.{field}").alias("value")
    ).where(F.coalesce(F.col("value"), F.lit("")) != "")


def urls_from_shopify(api_pages: DataFrame, size: int = 250, max_pages: int | None = None) -> DataFrame:
    """``<base>/products/<handle>`` of ``api_pages(site, base, page, body)``."""
    body = F.when(strip(F.col("body")).startswith("{"), F.col("body"))
    items = F.from_json(body, "products array<struct<handle:string>>")["products"]
    found = _urls_from_api(api_pages, items, "handle", size, max_pages)
    return found.select("site", F.concat("base", F.lit("/products/"), "value").alias("url"), "pos")


def _listed(field: str) -> Column:
    body = F.when(strip(F.col("body")).startswith("["), F.col("body"))
    return F.from_json(body, f"array<struct<{field}:string>>")


def urls_from_woo(api_pages: DataFrame, size: int = 100, max_pages: int | None = None) -> DataFrame:
    found = _urls_from_api(api_pages, _listed("permalink"), "permalink", size, max_pages)
    return found.select("site", F.col("value").alias("url"), "pos")


def urls_from_wp_rest(api_pages: DataFrame, woo: DataFrame, size: int = 100, max_pages: int | None = None) -> DataFrame:
    """Post links, for the sites where the store API gave none."""
    found = _urls_from_api(api_pages, _listed("link"), "link", size, max_pages)
    return found.join(woo.select("site").distinct(), "site", "left_anti").select(
        "site", F.col("value").alias("url"), "pos"
    )


# ── Links and crawling ────────────────────────────────────────────────────


def anchor_hrefs(html: Column) -> Column:
    """Raw ``href`` values of the anchors of a page, outside comments and scripts."""
    bare = F.regexp_replace(
        F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", ""
    )
    raw = F.regexp_extract_all(
        bare, F.lit(r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"), F.lit(1)
    )
    return F.transform(raw, lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))


def page_anchors(pages: DataFrame) -> DataFrame:
    """``(page_url, pos, href)``: every anchor, resolved against its page, fragment and query cut."""
    hrefs = unescape_all(anchor_hrefs(F.col("html")))
    listed = pages.select(F.col("url").alias("page_url"), hrefs.alias("hrefs"))
    raw = listed.select("page_url", F.posexplode("hrefs").alias("pos", "raw"))
    resolved = resolve_url(F.substring_index("raw", "#", 1), F.col("page_url"))
    return raw.select("page_url", "pos", F.substring_index(resolved, "?", 1).alias("href"))


def extract_links(pages: DataFrame) -> DataFrame:
    """Links of a page to scrapable pages of its own host."""
    return page_anchors(pages).where(is_scrapable_page(F.col("href"), host_of(F.col("page_url"))))


def urls_from_opencart(pages: DataFrame, selectors: dict = SELECTORS) -> DataFrame:
    """Product links of listing pages ``(site, url, html)``: listing markup, or product routes."""
    first, last = rule_ids("listing", selectors)
    anchors = pages.select(
        "site", F.col("url").alias("page_url"),
        F.explode(F.filter(element_array(F.col("html"), selectors), lambda e: e["tag"] == "a")).alias("a"),
    ).select(
        "site", "page_url", F.col("a.attrs")["href"].alias("href"),
        F.exists("a.hits", lambda h: h.between(first, last)).alias("listed"),
    )
    is_route = F.col("href").contains("product_id=") | F.col("href").contains("route=product/product")
    kept = anchors.where((F.coalesce(F.col("href"), F.lit("")) != "") & (F.col("listed") | is_route))
    resolved = kept.select(
        "site", "page_url", resolve_url(F.substring_index("href", "#", 1), F.col("page_url")).alias("full")
    )
    # Listing links lose the search parameters they carry; route links are nothing without theirs.
    plain = F.when(F.col("full").rlike("product_id=|route="), F.col("full")).otherwise(
        F.substring_index("full", "?", 1)
    )
    return (
        resolved.select("site", "page_url", plain.alias("url"))
        .where(is_scrapable_page(F.col("url"), host_of(F.col("page_url"))))
        .select("site", "url")
        .distinct()
    )


def link_frontier(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Link targets ``(site, url)`` that are not visited yet."""
    targets = links.select("site", F.col("href").alias("url")).distinct()
    return targets.join(visited.select("site", "url"), ["site", "url"], "left_anti")


def crawl_link_graph(links: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Product URLs reached by walking stored links from the seeds; ``limit`` pages a site, if stated.

    ``links(site, page_url, pos, href)`` holds scrapable same-host links, ``seeds(site, url,
    pos)``. A round visits one level of every site at once, listings before other pages, in
    queue order within each; the links are stored once; targets with a product hint are harvested and not visited. Sites
    without any are inferred by URL shape. Rounds are checkpointed and end when no site has
    pages left to visit.
    """
    edges = cut_lineage(links.select("site", F.col("page_url").alias("url"), "pos", "href"))
    with_pages = edges.select("site", "url").distinct()
    frontier = seeds.groupBy("site", "url").agg(F.min(F.struct(F.lit(0).alias("from"), "pos")).alias("place"))
    visited, depth = None, 0
    while True:
        if visited is not None:
            used = visited.groupBy("site").agg(F.count(F.lit(1)).alias("_used"))
            frontier = frontier.join(visited, ["site", "url"], "left_anti").join(used, "site", "left")
        else:
            frontier = frontier.withColumn("_used", F.lit(0))
        listing_first = frontier.withColumn("_listing", looks_like_listing(F.col("url")))
        ranked = _within(ranked_in_site(listing_first, [F.col("_listing").desc(), "place", "url"]), limit)
        now = cut_lineage(ranked.select("site", "url", F.lit(depth).alias("depth"), F.col("_rank").alias("rank")))
        if now.isEmpty():
            break
        visited = now if visited is None else cut_lineage(visited.unionByName(now))
        frontier = (
            edges.join(now, ["site", "url"])
            .where(~has_product_hint(F.col("href")))
            .groupBy("site", F.col("href").alias("url"))
            .agg(F.min(F.struct(F.col("rank").alias("from"), "pos")).alias("place"))
            .join(with_pages, ["site", "url"], "left_semi")
        )
        depth += 1
    if visited is None:
        visited = seeds.select("site", "url").where(F.lit(False))
    reached = edges.join(visited.select("site", "url"), ["site", "url"], "left_semi").select(
        "site", F.col("href").alias("url")
    ).distinct()
    hinted = reached.where(has_product_hint(F.col("url")))
    others = reached.join(hinted.select("site").distinct(), "site", "left_anti").select(
        "site", host_of(F.col("url")).alias("host"), "url", F.col("url").alias("pos")
    )
    return hinted.unionByName(infer_product_urls(others).select("site", "url"))


# ── Merging strategies ────────────────────────────────────────────────────


def strategy_counts(found: DataFrame) -> DataFrame:
    """URLs per site and strategy, before repeats are dropped."""
    return found.groupBy("site", "strategy").agg(F.count(F.lit(1)).alias("n"))


def ordered_union(found: DataFrame) -> DataFrame:
    """``found(site, strategy, place, url)``: each URL once, where it is first seen."""
    return found.groupBy("site", "url").agg(
        F.min_by("strategy", "place").alias("strategy"), F.min("place").alias("place")
    )


def applies_to(strategy: str, platform: Column, supported: Column) -> Column:
    """Whether a strategy is tried on a platform."""
    rules = {
        "shopify_api": (platform == "shopify") | ~supported,
        "woocommerce_api": platform.isin("woocommerce", "wordpress"),
        "wp_rest_api": platform.isin("woocommerce", "wordpress"),
        "opencart_routes": platform == "opencart",
    }
    return rules.get(strategy, F.lit(True))


# Order in which strategies are merged.
STRATEGIES = ["sitemaps", "shopify_api", "woocommerce_api", "wp_rest_api", "opencart_routes", "listing_crawl"]


def tag_strategies(strategies: dict) -> DataFrame:
    """One table ``(site, strategy, place, url)`` of the outputs ``{name: (site, url[, pos])}``.

    ``pos`` is a struct of two integers; a strategy without one lists its URLs sorted.
    """
    merged = None
    for rank, name in enumerate(STRATEGIES):
        if name not in strategies:
            continue
        rows = strategies[name]
        pos = F.col("pos") if "pos" in rows.columns else F.struct(F.lit(0), F.lit(0))
        place = F.struct(F.lit(rank).alias("rank"), pos.cast("struct<a:int,b:int>").alias("pos"), "url")
        rows = rows.select("site", F.lit(name).alias("strategy"), place.alias("place"), "url")
        merged = rows if merged is None else merged.unionByName(rows)
    return merged


def discover_products(platforms: DataFrame, strategies: dict) -> DataFrame:
    """Merge strategy outputs into one ordered list per site, ``(site, url, strategy, place)``.

    ``platforms(site, platform, supported)`` decides which strategies count; the listing crawl
    counts only for sites where nothing else found anything.
    """
    tried = F.lit(False)
    for name in strategies:
        tried = tried | (
            (F.col("strategy") == name) & applies_to(name, F.col("platform"), F.col("supported"))
        )
    found = tag_strategies(strategies).join(platforms, "site").where(tried)
    crawled = F.col("strategy") == "listing_crawl"
    others = found.where(~crawled)
    fallback = found.where(crawled).join(others.select("site").distinct(), "site", "left_anti")
    return ordered_union(others.unionByName(fallback))


# ── Platforms ─────────────────────────────────────────────────────────────


def detect_platform(html: Column, rules: list = PLATFORM_RULES) -> Column:
    """``struct(id, name, supported, confidence, evidence)`` of the first platform with evidence."""

    def verdict(pid, name, supported, confidence, evidence):
        return F.struct(
            F.lit(pid).alias("id"), F.lit(name).alias("name"), F.lit(supported).alias("supported"),
            confidence.alias("confidence"), evidence.alias("evidence"),
        )

    none = F.array().cast("array<string>")
    options = []
    for pid, name, supported, patterns in rules:
        seen = F.filter(
            F.array(*[F.when(html.rlike(f"(?i){p}"), F.lit(text)) for p, text in patterns]),
            lambda e: e.isNotNull(),
        )
        confidence = F.when(F.size(seen) >= 2, F.lit("high")).otherwise(F.lit("medium"))
        options.append(verdict(pid, name, supported, confidence, seen))
    found = F.get(F.filter(F.array(*options), lambda v: F.size(v["evidence"]) > 0), F.lit(0))
    blank = F.coalesce(html, F.lit("")) == ""
    return F.when(blank, verdict("unknown", "Unknown", False, F.lit("none"), none)).otherwise(
        F.coalesce(found, verdict("unknown", "Unrecognised platform", False, F.lit("none"), none))
    )


def wordpress_facts(html: Column) -> Column:
    """``struct(version, themes, plugins, plugin_count)``, NULL when the page shows none."""

    def slugs(folder):
        pattern = rf"(?i)/wp-content/{folder}/([a-z0-9][a-z0-9._-]*)"
        return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))))

    version = F.nullif(F.regexp_extract(html, r"(?i)content=[\"']WordPress\s+([\d.]+)", 1), F.lit(""))
    themes, plugins = slugs("themes"), slugs("plugins")
    facts = F.struct(
        version.alias("version"), themes.alias("themes"), plugins.alias("plugins"), F.size(plugins).alias("plugin_count"),
    )
    return F.when((F.size(themes) > 0) | (F.size(plugins) > 0) | version.isNotNull(), facts)
