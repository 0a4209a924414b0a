"""Queries over what a crawler left: sitemaps, API payloads, link graphs, responses, run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import urls as U
from shelfmark.operators import context as CX
from shelfmark.operators import discovery as D
from shelfmark.operators import files as FI
from shelfmark.operators import quality as Q
from shelfmark.operators.catalogue import run_progress
from shelfmark.operators.report import site_report
from shelfmark.operators.rules import platform_rules_of
from shelfmark.plans.registry import query
from shelfmark.plans.tables import ATTEMPT_ORDER, ATTEMPTS_SQL, attempts, product_facts, table
from shelfmark.runtime import scratch_path
from shelfmark.sources import crawl as SC

# ── Sitemaps made of parts: a store a nation, files of twenty parts each ──
# Store kinds by nation number mod 4: product sitemaps, hinted paths, one dominant shape, mixed shapes.

FILE_PARTS = 500
SITE_SQL = "concat('nation-', p_partkey % 25)"
BASE_SQL = f"concat('https://', {SITE_SQL}, '.example')"
KIND_SQL = "(p_partkey % 25) % 4"
URL_SQL = f"""concat({BASE_SQL}, CASE {KIND_SQL} WHEN 0 THEN '/a&b/' WHEN 1 THEN '/product/' WHEN 2 THEN '/thing/'
  ELSE concat('/shape', (p_partkey // 25) % 3, '/') END, 'part-', p_partkey)"""
MAP_SQL = f"""concat({BASE_SQL}, CASE WHEN {KIND_SQL} = 0 THEN '/product-sitemap' ELSE '/sitemap-main' END, p_partkey // 500, '.xml')"""
PARTS_SQL = f"""
urls AS (SELECT p_partkey, {SITE_SQL} AS site, {BASE_SQL} AS base, {KIND_SQL} AS kind, {URL_SQL} AS url,
  {MAP_SQL} AS sitemap_url, p_partkey // 500 AS file FROM part)"""


def _parts(spark, sf):
    key = F.col("p_partkey")
    site = F.concat(F.lit("nation-"), (key % 25).cast("string"))
    base = F.concat(F.lit("https://"), site, F.lit(".example"))
    kind = (key % 25) % 4
    shape = F.concat(F.lit("/shape"), (F.floor(key / 25) % 3).cast("string"), F.lit("/"))
    folder = F.when(kind == 0, "/a&b/").when(kind == 1, "/product/").when(kind == 2, "/thing/").otherwise(shape)
    file = F.floor(key / FILE_PARTS)
    named = F.when(kind == 0, "/product-sitemap").otherwise("/sitemap-main")
    return table(spark, sf, "part").select(
        "p_partkey", site.alias("site"), base.alias("base"), kind.alias("kind"),
        F.concat(base, folder, F.lit("part-"), key.cast("string")).alias("url"), file.alias("file"),
        F.concat(base, named, file.cast("string"), F.lit(".xml")).alias("sitemap_url"),
    )


def leaf_sitemaps(spark, sf):
    """Leaf documents: twenty locations a file by construction, plus pages that are no products."""
    def loc(value):
        return F.concat(F.lit("<url><loc> "), F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("\n</loc></url>"))

    files = _parts(spark, sf).groupBy("site", "base", "kind", "sitemap_url", "file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "url"))), lambda u: loc(u["url"])), "").alias("locs")
    )
    noise = F.concat(
        loc(F.concat("base", F.lit("/blog/post"))), loc(F.concat("base", F.lit("/cart"))), loc(F.concat("base", F.lit("/i/x.jpg"))),
        loc(F.lit("https://elsewhere.example/product/x1")), F.lit("<!-- <loc>hidden</loc> -->"),
    )
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "locs", noise, F.lit("</urlset>"))
    return files.select(
        "site", F.concat("site", F.lit(".example")).alias("host"), F.col("file").cast("int").alias("visit"), "sitemap_url", xml.alias("xml")
    )


def _sites(spark, sf):
    return _parts(spark, sf).select("site", "base", "kind").distinct()


INDEX_FILES = 50


def _index_url(file):
    return F.concat(F.col("base"), F.lit("/sitemap_index"), F.floor(file / INDEX_FILES).cast("string"), F.lit(".xml"))


def index_sitemaps(spark, sf):
    """Indexes of fifty leaf files each, every one with a child that is missing."""
    files = _parts(spark, sf).groupBy("site", "base", "sitemap_url").agg(F.first("file").alias("file"))
    # Fifty entries at most by construction, however many files a store has.
    children = files.groupBy("site", "base", _index_url(F.col("file")).alias("index_url")).agg(
        F.array_sort(F.collect_list(F.struct("file", "sitemap_url"))).alias("c")
    )
    listed = F.transform("c", lambda c: F.concat(F.lit("<sitemap><loc>"), c["sitemap_url"], F.lit("</loc></sitemap>")))
    missing = F.concat(F.lit("<sitemap><loc>"), "index_url", F.lit(".missing</loc></sitemap>"))
    return children.select(
        "site", F.col("index_url").alias("sitemap_url"),
        F.concat(F.lit("<SitemapIndex>"), F.array_join(listed, ""), missing, F.lit("</SitemapIndex>")).alias("xml"),
    )


NOISE_SQL = """(VALUES ('/blog/post'), ('/cart'), ('/i/x.jpg'), (NULL)) n(path)"""


@query("parse_sitemaps", f"""WITH {PARTS_SQL}
SELECT sitemap_url, url AS loc FROM urls UNION ALL
SELECT sitemap_url, coalesce(base || n.path, 'https://elsewhere.example/product/x1') AS loc
FROM (SELECT DISTINCT sitemap_url, base FROM urls) CROSS JOIN {NOISE_SQL}""")
def parse_sitemaps(spark, sf):
    return D.parse_sitemaps(leaf_sitemaps(spark, sf)).select("sitemap_url", "loc")


@query("classify_sitemaps", f"""WITH {PARTS_SQL}
SELECT DISTINCT sitemap_url, false AS is_index, kind = 0 AS is_product FROM urls
UNION ALL SELECT DISTINCT concat(base, '/sitemap_index', file // 50, '.xml'), true, false FROM urls""")
def classify_sitemaps(spark, sf):
    every = leaf_sitemaps(spark, sf).select("sitemap_url", "xml").unionByName(
        index_sitemaps(spark, sf).select("sitemap_url", "xml"))
    return D.classify_sitemaps(every).select("sitemap_url", "is_index", "is_product")


@query("expand_sitemap_index", f"""WITH {PARTS_SQL}, files AS (
  SELECT site, sitemap_url, file // 50 AS k, file, false AS gone FROM urls GROUP BY ALL
  UNION ALL SELECT site, concat(base, '/sitemap_index', file // 50, '.xml.missing'), file // 50, 1e9, true FROM urls GROUP BY ALL),
indexes AS (SELECT DISTINCT site, base, file // 50 AS k FROM urls),
counted AS (SELECT site, count(*) AS n FROM indexes GROUP BY site),
placed AS (SELECT files.site, sitemap_url, gone, n + row_number() OVER (PARTITION BY files.site ORDER BY k, file) - 1 AS visit
  FROM files JOIN counted USING (site))
SELECT site, concat(base, '/sitemap_index', k, '.xml') AS sitemap_url, CAST(k AS INTEGER) AS visit, true AS found FROM indexes
UNION ALL SELECT site, sitemap_url, CAST(visit AS INTEGER), NOT gone FROM placed""")
def expand_sitemap_index(spark, sf):
    documents = leaf_sitemaps(spark, sf).select("site", "sitemap_url", "xml").unionByName(index_sitemaps(spark, sf))
    seeds = _parts(spark, sf).select(
        "site", _index_url(F.col("file")).alias("sitemap_url"), F.floor(F.col("file") / INDEX_FILES).cast("int").alias("pos")
    ).distinct()
    return D.expand_sitemap_index(documents, seeds)


def _robots(spark, sf):
    return _sites(spark, sf).where("kind <> 3").select("site", F.concat(
        F.lit("User-agent: *\nSitemap: "), "base", F.lit("/sitemap_index.xml\r\nsitemaps: no\n  SITEMAP:"), "base", F.lit("/extra.xml \nSitemap:\n"),
    ).alias("body"))


@query("parse_robots", f"""WITH {PARTS_SQL}
SELECT DISTINCT site, p.pos, concat(base, p.path) AS sitemap_url FROM urls
CROSS JOIN (VALUES (0, '/sitemap_index.xml'), (1, '/extra.xml')) p(pos, path) WHERE kind <> 3""")
def parse_robots(spark, sf):
    return D.parse_robots(_robots(spark, sf))


@query("sitemap_candidates", f"""WITH {PARTS_SQL}
SELECT DISTINCT site, p.pos, concat(base, p.path) AS sitemap_url FROM urls CROSS JOIN (VALUES
  (true, 0, '/sitemap_index.xml'), (true, 1, '/extra.xml'), (true, 2, '/sitemap.xml'), (true, 3, '/wp-sitemap.xml'),
  (true, 4, '/product-sitemap.xml'), (true, 5, '/sitemap.xml.gz'), (true, 6, '/sitemap_products_1.xml'), (true, 7, '/pub/sitemap.xml'),
  (true, 8, '/sitemap/sitemap.xml'), (false, 0, '/sitemap_index.xml'), (false, 1, '/sitemap.xml'), (false, 2, '/wp-sitemap.xml'),
  (false, 3, '/product-sitemap.xml'), (false, 4, '/sitemap.xml.gz'), (false, 5, '/sitemap_products_1.xml'), (false, 6, '/pub/sitemap.xml'),
  (false, 7, '/sitemap/sitemap.xml')) p(named, pos, path) WHERE (kind <> 3) = p.named""")
def sitemap_candidates(spark, sf):
    return D.sitemap_candidates(_sites(spark, sf), _robots(spark, sf))


SITEMAP_URLS_SQL = PARTS_SQL + """, sized AS (SELECT *, count(*) OVER (PARTITION BY site) AS total FROM urls),
from_sitemaps AS (SELECT site, url, file, p_partkey FROM sized WHERE kind IN (0, 1) OR (kind = 2 AND total >= 20))"""


@query("urls_from_sitemaps", f"WITH {SITEMAP_URLS_SQL} SELECT site, url FROM from_sitemaps")
def urls_from_sitemaps(spark, sf):
    """Product sitemaps, hinted paths, or the dominant shape; mixed shapes give nothing."""
    return D.urls_from_sitemaps(leaf_sitemaps(spark, sf)).select("site", "url")


@query("infer_product_urls", """WITH u AS (
  SELECT site, url, pos, concat('/', regexp_extract(url, '^https://[^/]*/([^/?#]*)', 1), '/') AS key FROM (
    SELECT concat('host-', o_custkey % 7) AS site, o_orderkey AS pos, concat('https://host-', o_custkey % 7,
      CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 3 > 0 THEN '/model/' WHEN o_custkey % 7 = 1 AND o_orderkey % 100 = 0 THEN '/item/'
        WHEN o_custkey % 7 = 2 THEN '/wares/' WHEN o_custkey % 7 = 3 THEN concat('/s', o_orderkey % 5, '/') ELSE '/thing-x/' END, o_orderkey) AS url FROM orders)),
g AS (SELECT site, key, count(*) AS n, min(pos) AS first FROM u GROUP BY ALL),
k AS (SELECT site, arg_min(key, first) AS key FROM g WHERE n >= 5 AND key IN ('/product/', '/item/') GROUP BY site),
l AS (SELECT site, key, n, sum(n) OVER (PARTITION BY site) AS total, row_number() OVER (PARTITION BY site ORDER BY n DESC, first) AS r FROM g),
c AS (SELECT l.site, coalesce(k.key, CASE WHEN l.n / l.total >= 0.66 AND l.n >= 20 THEN l.key END) AS key
  FROM l LEFT JOIN k USING (site) WHERE r = 1 AND l.total >= 5)
SELECT u.site, url FROM u JOIN c ON c.site = u.site AND c.key = u.key""")
def infer_product_urls(spark, sf):
    host, order = F.col("o_custkey") % 7, F.col("o_orderkey")
    site = F.concat(F.lit("host-"), host.cast("string"))
    folder = (
        F.when((host == 0) & (order % 3 > 0), "/model/").when((host == 1) & (order % 100 == 0), "/item/")
        .when(host == 2, "/wares/").when(host == 3, F.concat(F.lit("/s"), (order % 5).cast("string"), F.lit("/"))).otherwise("/thing-x/")
    )
    urls = table(spark, sf, "orders").select(
        site.alias("site"), site.alias("host"), F.concat(F.lit("https://"), site, folder, order.cast("string")).alias("url"), order.alias("pos")
    )
    return D.infer_product_urls(urls).select("site", "url")


# ── Platform APIs: twenty items a page ────────────────────────────────────

PAGE_ITEMS = 20
# Every fifth store has a half-empty third page, where paging stops.
API_SQL = PARTS_SQL + """, listed AS (SELECT *, file + 1 AS page FROM urls
  WHERE NOT ((p_partkey % 25) % 5 = 0 AND file = 2 AND (p_partkey // 25) % 2 = 0)),
sizes AS (SELECT site, page, count(*) AS n FROM listed GROUP BY ALL),
stops AS (SELECT site, min(page) AS stop FROM sizes WHERE n < 20 GROUP BY site),
served AS (SELECT listed.* FROM listed LEFT JOIN stops USING (site) WHERE page <= coalesce(stop, 1000000))"""


def _api_pages(spark, sf, item, wrap):
    key = F.col("p_partkey")
    kept = _parts(spark, sf).where(~((key % 25 % 5 == 0) & (F.col("file") == 2) & (F.floor(key / 25) % 2 == 0)))
    # Pages hold at most twenty items by construction.
    pages = kept.groupBy("site", "base", (F.col("file") + 1).cast("int").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(key, item.alias("item")))).alias("items"))
    return pages.select("site", "base", "page", wrap(F.transform("items", lambda i: i["item"])).alias("body"))


def shopify_pages(spark, sf):
    handle = F.struct(F.concat(F.lit("h-"), F.col("p_partkey").cast("string")).alias("handle"))
    return _api_pages(spark, sf, handle, lambda items: F.to_json(F.struct(items.alias("products"))))


def post_pages(spark, sf, field):
    return _api_pages(spark, sf, F.struct(F.col("url").alias(field)), F.to_json)


@query("urls_from_shopify", f"WITH {API_SQL} SELECT site, concat(base, '/products/h-', p_partkey) AS url FROM served")
def urls_from_shopify(spark, sf):
    return D.urls_from_shopify(shopify_pages(spark, sf), PAGE_ITEMS).select("site", "url")


@query("urls_from_woo", f"WITH {API_SQL} SELECT site, url FROM served")
def urls_from_woo(spark, sf):
    return D.urls_from_woo(post_pages(spark, sf, "permalink"), PAGE_ITEMS).select("site", "url")


@query("urls_from_wp_rest", f"WITH {API_SQL} SELECT site, url FROM served WHERE kind <> 0")
def urls_from_wp_rest(spark, sf):
    woo = D.urls_from_woo(post_pages(spark, sf, "permalink"), PAGE_ITEMS)
    woo = woo.join(_sites(spark, sf).where("kind = 0"), "site", "left_semi")
    return D.urls_from_wp_rest(post_pages(spark, sf, "link"), woo, PAGE_ITEMS).select("site", "url")


@query("paging_stop_rule", f"WITH {API_SQL} SELECT DISTINCT site, page FROM served")
def paging_stop_rule(spark, sf):
    sized = shopify_pages(spark, sf).withColumn("n", F.size(F.from_json("body", "products array<struct<handle:string>>")["products"]))
    return D.full_pages(sized, PAGE_ITEMS).select("site", "page")


def _listing_pages(spark, sf):
    """Listing pages of twenty products each, half linked by theme markup and half by product routes."""
    key = F.col("p_partkey").cast("string")
    markup = F.concat(F.lit('<div class="product-thumb"><a href="/wares-'), key, F.lit('?page=2&amp;x=1#top">x</a></div>'))
    route = F.concat(F.lit('<p><a href="index.php?route=product/product&amp;product_id='), key, F.lit('">x</a></p>'))
    other = F.concat(F.lit('<p><a href="/elsewhere-'), key, F.lit('">x</a></p>'))
    link = F.concat(F.when(F.col("p_partkey") % 2 == 0, markup).otherwise(route), other)
    pages = _parts(spark, sf).groupBy("site", "base", "file").agg(F.array_join(F.collect_list(link), "").alias("body"))
    return pages.select("site", F.concat("base", F.lit("/index.php?page="), F.col("file").cast("string")).alias("url"),
                        F.concat(F.lit("<html><body>"), "body", F.lit("</body></html>")).alias("html"))


@query("urls_from_opencart", f"""WITH {PARTS_SQL} SELECT site, concat(base, '/wares-', p_partkey) AS url
FROM urls WHERE p_partkey % 2 = 0""")
def urls_from_opencart(spark, sf):
    """Product routes behind a bare front controller count as the site root, so they are no pages."""
    return D.urls_from_opencart(_listing_pages(spark, sf))


# ── Crawl: home page, four listings, each in pages of twenty products ─────

def _links(spark, sf):
    parts = _parts(spark, sf)
    site_of = parts.select("site", "base").distinct()
    listing = F.concat("base", F.lit("/kind-x"), (F.floor(F.col("p_partkey") / 25) % 4).cast("string"))
    home = site_of.select(
        "site", F.concat("base", F.lit("/")).alias("page_url"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.concat(F.col("base"), F.lit("/kind-x"), n.cast("string")))).alias("pos", "href"),
    )
    folder = F.when(F.col("kind") == 3, "/ware-y/").otherwise("/product/")
    products = parts.select(
        "site", listing.alias("page_url"), F.col("p_partkey").cast("int").alias("pos"),
        F.concat("base", folder, F.col("p_partkey").cast("string")).alias("href"),
    )
    back = site_of.select("site", F.concat("base", F.lit("/kind-x1")).alias("page_url"), F.lit(-1).alias("pos"), F.concat("base", F.lit("/kind-x0")).alias("href"))
    return home.unionByName(products).unionByName(back)


CRAWL_SQL = PARTS_SQL + """, crawled AS (
  SELECT site, concat(base, CASE WHEN kind = 3 THEN '/ware-y/' ELSE '/product/' END, p_partkey) AS url, p_partkey, kind,
    count(*) OVER (PARTITION BY site) AS n FROM urls)"""


def _crawled(spark, sf):
    seeds = _sites(spark, sf).select("site", F.posexplode(
        F.transform(F.array(*[F.lit(p) for p in D.CRAWL_SEEDS]), lambda p: F.concat(F.col("base"), p))).alias("pos", "url"))
    return D.crawl_link_graph(_links(spark, sf), seeds.select("site", "url", "pos"))


@query("crawl_link_graph", f"""WITH {CRAWL_SQL}
SELECT site, url FROM crawled WHERE kind <> 3 OR (n >= 20 AND n / (n + 4) >= 0.66)""")
def crawl_link_graph(spark, sf):
    """Stores of kind 3 use a path without a hint: their shape decides."""
    return _crawled(spark, sf)


# ── Merging ───────────────────────────────────────────────────────────────

def _platforms(spark, sf):
    kind = F.col("kind")
    return _sites(spark, sf).select(
        "site", F.when(kind == 0, "woocommerce").when(kind == 1, "shopify").when(kind == 2, "opencart").otherwise("unknown").alias("platform"),
        kind.isin(0, 1).alias("supported"),
    )


def _strategies(spark, sf, *names):
    build = {
        "sitemaps": lambda: D.urls_from_sitemaps(leaf_sitemaps(spark, sf)),
        "shopify_api": lambda: D.urls_from_shopify(shopify_pages(spark, sf), PAGE_ITEMS),
        "woocommerce_api": lambda: D.urls_from_woo(post_pages(spark, sf, "permalink"), PAGE_ITEMS),
        "opencart_routes": lambda: D.urls_from_opencart(_listing_pages(spark, sf)),
        "listing_crawl": lambda: _crawled(spark, sf),
    }
    return {name: build[name]() for name in names or build}


MERGED_SQL = API_SQL + SITEMAP_URLS_SQL[len(PARTS_SQL):] + CRAWL_SQL[len(PARTS_SQL):] + """, found AS (
  SELECT site, url, 0 AS rank, 'sitemaps' AS strategy FROM from_sitemaps
  UNION ALL SELECT site, concat(base, '/products/h-', p_partkey), 1, 'shopify_api' FROM served WHERE kind <> 0
  UNION ALL SELECT site, url, 2, 'woocommerce_api' FROM served WHERE kind = 0
  UNION ALL SELECT site, concat(base, '/wares-', p_partkey), 4, 'opencart_routes' FROM urls WHERE kind = 2 AND p_partkey % 2 = 0),
every AS (SELECT * FROM found UNION ALL SELECT site, url, 5, 'listing_crawl' FROM crawled
  WHERE (kind <> 3 OR (n >= 20 AND n / (n + 4) >= 0.66)) AND site NOT IN (SELECT site FROM found))"""


@query("discover_products", f"WITH {MERGED_SQL} SELECT site, url, arg_min(strategy, rank) AS strategy FROM every GROUP BY site, url")
def discover_products(spark, sf):
    return D.discover_products(_platforms(spark, sf), _strategies(spark, sf)).select("site", "url", "strategy")


@query("ordered_union", f"""WITH {API_SQL + SITEMAP_URLS_SQL[len(PARTS_SQL):]}
SELECT site, url, min(s) AS strategy FROM (SELECT site, url, 'sitemaps' AS s FROM from_sitemaps
  UNION ALL SELECT site, url, 'woocommerce_api' FROM served) GROUP BY site, url""")
def ordered_union(spark, sf):
    kept = _strategies(spark, sf, "sitemaps", "woocommerce_api")
    return D.ordered_union(D.tag_strategies(kept)).select("site", "url", "strategy")


@query("strategy_counts", f"""WITH {API_SQL + SITEMAP_URLS_SQL[len(PARTS_SQL):]}
SELECT site, strategy, count(*) AS n FROM (SELECT site, 'sitemaps' AS strategy FROM from_sitemaps
  UNION ALL SELECT site, 'woocommerce_api' FROM served) GROUP BY site, strategy""")
def strategy_counts(spark, sf):
    kept = _strategies(spark, sf, "sitemaps", "woocommerce_api")
    return D.strategy_counts(D.tag_strategies(kept))


# ── Platforms and reports: a store per supplier ───────────────────────────

STORE_SQL = "concat('https://store-', s_suppkey, '.example')"
# Shapes by supplier number mod 6: WooCommerce, Shopify, WordPress, OpenCart, unreachable, unknown.


def _homepages(spark, sf):
    key = F.col("s_suppkey")
    number = key.cast("string")
    shape = key % 6
    woo = F.concat(F.lit('<link href="/wp-content/plugins/woocommerce/a.css"><link href="/wp-content/plugins/seo-'), number,
                   F.lit('/b.js"><link href="/wp-content/themes/shopfront/s.css"><body class="woocommerce-page">'))
    shopify = F.concat(F.lit('<script src="https://CDN.shopify.com/'), number, F.lit('.js"></script>'))
    wordpress = F.concat(F.lit('<meta name="generator" content="WordPress 6.'), number, F.lit('"><img src="/wp-content/x.png"><a href="/wp-includes/y">'))
    opencart = F.concat(F.lit('<a href="index.php?route=common/home">'), number)
    html = (
        F.when(shape == 0, woo).when(shape == 1, shopify).when(shape == 2, wordpress).when(shape == 3, opencart)
        .when(shape == 5, F.concat(F.lit("<p>plain "), number))
    )
    base = F.concat(F.lit("https://store-"), number, F.lit(".example"))
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("store-"), number).alias("site"), base.alias("base"), html.alias("html"),
        F.when(shape == 4, F.when(key % 4 == 0, "HTTP 403").otherwise("timeout")).alias("reason"),
        F.when(key % 5 == 0, "safari").otherwise("chrome").alias("profile"),
    )


@query("detect_platform", """SELECT s_suppkey, p.id, p.confidence, p.evidence, p.supported FROM supplier JOIN (VALUES
  (0, 'woocommerce', 'high', 'WooCommerce plugin assets|WooCommerce CSS/JS markers', true), (1, 'shopify', 'medium', 'Shopify CDN assets', true),
  (2, 'wordpress', 'high', 'wp-content asset paths|wp-includes asset paths|WordPress generator meta tag', false),
  (3, 'opencart', 'medium', 'OpenCart routing', false), (4, 'unknown', 'none', '', false), (5, 'unknown', 'none', '', false))
  p(shape, id, confidence, evidence, supported) ON s_suppkey % 6 = p.shape""")
def detect_platform(spark, sf):
    found = _homepages(spark, sf).select("s_suppkey", D.detect_platform(F.col("html")).alias("p"))
    return found.select("s_suppkey", "p.id", "p.confidence", F.array_join("p.evidence", "|").alias("evidence"), "p.supported")


@query("user_platform_rules", """SELECT s_suppkey, p.id, p.confidence, p.evidence, p.supported FROM supplier JOIN (VALUES
  (0, 'woocommerce', 'high', 'WooCommerce plugin assets|WooCommerce CSS/JS markers', true), (1, 'shopify', 'medium', 'hosted scripts', false),
  (2, 'legacy', 'high', 'a picture|an include', false), (3, 'opencart', 'medium', 'OpenCart routing', false),
  (4, 'unknown', 'none', '', false), (5, 'builder', 'medium', 'a plain paragraph', true)) p(shape, id, confidence, evidence, supported) ON s_suppkey % 6 = p.shape""")
def user_platform_rules(spark, sf):
    """A user's platforms before the built-in ones, one of which they replace."""
    own = spark.createDataFrame([
        (0, "builder", "Site builder", True, r"<p>plain \d+", "a plain paragraph"), (1, "legacy", "Old theme", False, r"/wp-includes/y", "an include"),
        (1, "legacy", "Old theme", False, r"/wp-content/x\.png", "a picture"), (2, "shopify", "Shopify", False, r"cdn\.shopify\.com", "hosted scripts"),
    ], "rank int, platform string, name string, supported boolean, pattern string, evidence string")
    found = _homepages(spark, sf).select("s_suppkey", D.detect_platform(F.col("html"), platform_rules_of(own)).alias("p"))
    return found.select("s_suppkey", "p.id", "p.confidence", F.array_join("p.evidence", "|").alias("evidence"), "p.supported")


@query("wordpress_facts", """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 2 THEN concat('6.', s_suppkey) ELSE '' END AS version,
  CASE s_suppkey % 6 WHEN 0 THEN 'shopfront' ELSE '' END AS themes,
  CASE s_suppkey % 6 WHEN 0 THEN concat('seo-', s_suppkey, '|woocommerce') ELSE '' END AS plugins,
  CASE s_suppkey % 6 WHEN 0 THEN 2 WHEN 2 THEN 0 END AS plugin_count FROM supplier""")
def wordpress_facts(spark, sf):
    found = _homepages(spark, sf).select("s_suppkey", D.wordpress_facts(F.col("html")).alias("w"))
    return found.select(
        "s_suppkey", F.coalesce("w.version", F.lit("")).alias("version"), F.coalesce(F.array_join("w.themes", "|"), F.lit("")).alias("themes"),
        F.coalesce(F.array_join("w.plugins", "|"), F.lit("")).alias("plugins"), "w.plugin_count",
    )


@query("site_report", """SELECT concat('store-', s_suppkey) AS site, s_suppkey % 6 <> 4 AS reachable,
  CASE s_suppkey % 6 WHEN 4 THEN NULL WHEN 0 THEN CASE WHEN s_suppkey % 12 = 0 THEN 'sitemap' ELSE 'woocommerce_api' END
    WHEN 1 THEN 'shopify_api' WHEN 3 THEN CASE WHEN s_suppkey % 4 = 3 THEN 'shopify_api' ELSE 'opencart_routes' END
    ELSE CASE WHEN s_suppkey % 4 = 3 THEN 'shopify_api' ELSE 'listing_crawl' END END AS strategy,
  CASE s_suppkey % 6 WHEN 4 THEN NULL WHEN 0 THEN 40 + s_suppkey WHEN 1 THEN 3
    ELSE CASE WHEN s_suppkey % 4 = 3 THEN 3 END END AS estimated_products,
  CASE WHEN s_suppkey % 12 = 0 THEN 2 ELSE 0 END AS n_product_sitemaps,
  CASE WHEN s_suppkey % 6 = 4 THEN 0 WHEN s_suppkey % 6 = 0 THEN 1 WHEN s_suppkey % 6 = 1 THEN 1
    WHEN s_suppkey % 6 = 3 THEN 1 + CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END ELSE CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END END AS n_apis,
  CASE WHEN s_suppkey % 12 = 0 THEN 1 ELSE 0 END AS n_sitemaps,
  CASE WHEN s_suppkey % 6 <> 4 AND s_suppkey % 5 = 0 THEN 2 WHEN s_suppkey % 6 <> 4 THEN 1 ELSE 0 END AS n_notes FROM supplier""")
def site_report_query(spark, sf):
    key = F.col("s_suppkey")
    stores = _homepages(spark, sf)
    robots = stores.where(key % 12 == 0).select("site", F.concat(F.lit("Sitemap: "), "base", F.lit("/map.xml")).alias("body"))
    loc = lambda path: F.concat(F.lit("<loc>"), F.col("base"), F.lit(path), F.lit("</loc>"))
    sitemaps = stores.where(key % 12 == 0).select(
        F.concat("base", F.lit("/map.xml")).alias("sitemap_url"),
        F.concat(F.lit("<sitemapindex>"), loc("/product-1.xml"), loc("/product_cat.xml"), loc("/products-2.xml"), F.lit("</sitemapindex>")).alias("xml"),
    )
    body = F.lit('{"products":[{"handle":"a"},{"handle":"b"},{"handle":"c"}]}')
    no_headers = F.create_map().cast("map<string,string>")
    probes = stores.select("site", F.explode(F.array_compact(F.array(
        F.when(key % 6 == 0, F.struct(F.lit("woo").alias("endpoint"), F.lit(200).alias("status"),
                                      F.create_map(F.lit("X-WP-Total"), (key + 40).cast("string")).alias("headers"), F.lit("[]").alias("body"))),
        F.when((key % 6 == 1) | (key % 4 == 3), F.struct(F.lit("shopify").alias("endpoint"), F.lit(200).alias("status"), no_headers.alias("headers"), body.alias("body"))),
        F.when(key % 6 == 3, F.struct(F.lit("opencart").alias("endpoint"), F.lit(200).alias("status"), no_headers.alias("headers"), F.lit("").alias("body"))),
    ))).alias("p")).select("site", "p.*")
    report = site_report(stores, robots, sitemaps, probes)
    return report.select(
        "site", "reachable", "strategy", "estimated_products", F.size("product_sitemaps").alias("n_product_sitemaps"),
        F.size("apis").alias("n_apis"), F.size("sitemaps").alias("n_sitemaps"), F.size("notes").alias("n_notes"),
    )


# ── Responses, retries, hosts ─────────────────────────────────────────────

JUDGED = "WITH " + ATTEMPTS_SQL


def judged(spark, sf):
    return Q.classify_response(attempts(spark, sf)).withColumn("retry_after", F.nullif(Q.header(F.col("headers"), "retry-after"), F.lit("")))


@query("looks_like_challenge", "SELECT event_id, event_type = 'view' AND event_id % 5 = 0 AS value FROM events")
def looks_like_challenge(spark, sf):
    return attempts(spark, sf).select("event_id", Q.looks_like_challenge(F.col("body"), F.col("headers")).alias("value"))


@query("classify_response", JUDGED + " SELECT event_id, outcome, coalesce(reason, '') AS reason FROM judged")
def classify_response(spark, sf):
    return judged(spark, sf).select("event_id", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))


DELAY = """CASE WHEN last.outcome = 'throttled' AND last.shape <> 0 THEN least(CAST(CAST(round(last.value) AS BIGINT) AS DOUBLE), 60.0)
  WHEN pow(2, least(n - 1, 10)) >= 30 THEN 30.0 ELSE pow(2, least(n - 1, 10)) + 0.5 END"""


@query("retry_delay", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(CAST(event_id % 100 AS DOUBLE), 60.0)
  WHEN event_id % 20 >= 5 THEN 30.0 ELSE pow(2, event_id % 20) + 0.25 END AS delay FROM events""")
def retry_delay(spark, sf):
    key = F.col("event_id")
    stated = F.when(key % 3 == 0, (key % 100).cast("string")).otherwise("Wed, 21 Oct 2015")
    return table(spark, sf, "events").select("event_id", Q.retry_delay((key % 20).cast("int"), stated, F.lit(0.25)).alias("delay"))


@query("retry_plan", JUDGED + f""", s AS (
  SELECT url, count(*) AS n, arg_max(struct_pack(outcome := outcome, shape := shape, value := value, ts := ts), struct_pack(ts := ts, e := event_id)) AS last
  FROM judged GROUP BY url)
SELECT url, n AS attempts, last.outcome AS last_outcome, action, CASE WHEN action = 'retry' THEN {DELAY} END AS delay FROM (
  SELECT *, CASE last.outcome WHEN 'ok' THEN 'done' WHEN 'permanent' THEN 'drop' WHEN 'fingerprint' THEN 'blocked'
    ELSE CASE WHEN n >= 3 THEN 'give_up' ELSE 'retry' END END AS action FROM s)""")
def retry_plan(spark, sf):
    plan = Q.retry_plan(judged(spark, sf), ATTEMPT_ORDER, jitter=F.lit(0.5))
    return plan.select("url", "attempts", "last_outcome", "action", "delay")


@query("image_retry_plan", JUDGED + """, s AS (
  SELECT url, count(*) AS n, arg_max(outcome, struct_pack(ts := ts, e := event_id)) AS last_outcome FROM judged GROUP BY url),
a AS (SELECT *, CASE last_outcome WHEN 'ok' THEN 'done' WHEN 'permanent' THEN 'drop' WHEN 'fingerprint' THEN 'blocked'
  ELSE CASE WHEN n >= 4 THEN 'give_up' ELSE 'retry' END END AS action FROM s)
SELECT url, n AS attempts, last_outcome, action, CASE WHEN action = 'retry' THEN CAST(n * 2 AS DOUBLE) END AS delay FROM a""")
def image_retry_plan(spark, sf):
    """The attempts as if they were for images: one try and three more, linear waits."""
    return Q.image_retry_plan(judged(spark, sf), ATTEMPT_ORDER)


BLOCKS_SQL = JUDGED + """, w AS (
  SELECT host, max(CASE WHEN outcome = 'ok' THEN event_id END) AS won,
    arg_max(profile, event_id) FILTER (outcome = 'ok') AS profile FROM judged GROUP BY host)
SELECT w.host, count(j.event_id) AS blocked, count(j.event_id) >= 3 AS exhausted, coalesce(w.profile, '') AS profile
FROM w LEFT JOIN judged j ON j.host = w.host AND j.outcome = 'fingerprint' AND (w.won IS NULL OR j.event_id > w.won)
GROUP BY w.host, w.profile"""


@query("host_block_summary", BLOCKS_SQL)
def host_block_summary(spark, sf):
    """Event numbers rise with time in the driver's table, so either orders the attempts."""
    summary = Q.host_block_summary(judged(spark, sf), ATTEMPT_ORDER)
    return summary.withColumn("profile", F.coalesce("profile", F.lit("")))


def observations(spark, sf):
    """Price observations: a product per (host, number), asked plainly and with parameters."""
    key = F.col("event_id")
    host = F.concat(F.lit("host-"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(
        "event_id", "ts", host.alias("host"), F.concat(host, F.lit("/"), (key % 50).cast("string")).alias("url"),
        F.when(key % 3 == 0, "sid=EXPRESS").when(key % 3 == 1, "sid=SLOTTED").alias("param"),
        ((F.col("user_id") % 4 == 0) & (key % 3 == 0) & (F.col("value") > 20) | (F.col("user_id") % 4 == 1) & (key % 3 == 2)).alias("priced"),
    )


CONTEXT_SQL = """WITH o AS (
  SELECT event_id, concat('host-', user_id) AS host, event_id % 50 AS product, CASE event_id % 3 WHEN 0 THEN 'sid=EXPRESS' WHEN 1 THEN 'sid=SLOTTED' END AS param,
    (user_id % 4 = 0 AND event_id % 3 = 0 AND value > 20) OR (user_id % 4 = 1 AND event_id % 3 = 2) AS priced FROM events),
p AS (SELECT host, product, min(event_id) FILTER (priced AND param IS NOT NULL) AS won, bool_or(priced AND param IS NULL) AS plain FROM o GROUP BY ALL),
h AS (SELECT host, min(won) AS won, bool_or(plain) AS plain, count(*) FILTER (won IS NULL AND NOT plain) AS misses FROM p GROUP BY host)
SELECT h.host, coalesce(o.param, '') AS preferred_param, misses, CASE WHEN o.param IS NOT NULL THEN 'known'
  WHEN plain OR misses >= 4 THEN 'settled' ELSE 'probing' END AS state FROM h LEFT JOIN o ON o.event_id = h.won"""


@query("price_context", CONTEXT_SQL)
def price_context(spark, sf):
    known = Q.price_context(observations(spark, sf), ["event_id"])
    return known.withColumn("preferred_param", F.coalesce("preferred_param", F.lit("")))


def context_events(spark, sf):
    """A log of what memos are told: each host has a number of its own asks before it finds anything."""
    key, user = F.col("event_id"), F.col("user_id")
    event = (
        F.when((key % 11 == 3) & (user % 3 != 0), "found").when(key % 7 == 5, "credit").when((key % 13 == 1) & (user % 4 == 0), "settle").otherwise("ask"))
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("host-"), user.cast("string")).alias("host"), event.alias("event"),
        F.when(event == "found", F.concat(F.lit("sid="), (key % 5).cast("string"))).alias("param"))


# Each host's log is walked from event to event.
MEMO_SQL = """WITH RECURSIVE e AS (
  SELECT user_id, event_id % 5 AS param, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n,
    CASE WHEN event_id % 11 = 3 AND user_id % 3 <> 0 THEN 'found' WHEN event_id % 7 = 5 THEN 'credit' WHEN event_id % 13 = 1 AND user_id % 4 = 0 THEN 'settle' ELSE 'ask' END AS event
  FROM events),
w AS (SELECT DISTINCT user_id, n, 0::BIGINT AS i, NULL::BIGINT AS param, false AS settled, 0 AS probes, 0 AS misses FROM e
  UNION ALL SELECT w.user_id, w.n, e.i, CASE WHEN w.param IS NULL AND event = 'found' THEN e.param ELSE w.param END,
    settled OR event IN ('found', 'settle') OR (event = 'ask' AND probes >= 4),
    CASE WHEN event = 'ask' AND w.param IS NULL AND NOT settled AND probes < 4 THEN probes + 1 ELSE probes END,
    CASE WHEN event = 'credit' THEN 0 WHEN event = 'ask' AND w.param IS NOT NULL AND misses < 4 THEN misses + 1 ELSE misses END
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT concat('host-', user_id) AS host, CASE WHEN param IS NULL THEN '' ELSE concat('sid=', param) END AS preferred_param,
  CASE WHEN param IS NULL AND NOT settled THEN probes ELSE -1 END AS probes, CASE WHEN param IS NULL THEN 0 ELSE misses END AS misses,
  CASE WHEN param IS NOT NULL AND misses >= 4 THEN 'retired' WHEN param IS NOT NULL THEN 'known' WHEN settled THEN 'settled' ELSE 'probing' END AS state
FROM w WHERE i = n"""


def memo_rows(found):
    return found.select("host", F.coalesce("preferred_param", F.lit("")).alias("preferred_param"), F.coalesce("probes", F.lit(-1)).alias("probes"), "misses", "state")


@query("context_memo", MEMO_SQL)
def context_memo(spark, sf):
    return memo_rows(CX.context_memo(context_events(spark, sf), ["event_id"]))


@query("recover_missing_price", """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice
    WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 25 % 2 = 0 THEN p_retailprice + 2 ELSE p_retailprice + 1 END AS price_value,
  p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AS recovered FROM part""")
def recover_missing_price(spark, sf):
    """Stores of even number prefer the second parameter; every fifth product has no priced variant."""
    key = F.col("p_partkey")
    part = table(spark, sf, "part").withColumn("site", F.concat(F.lit("nation-"), (key % 25).cast("string"))).withColumn(
        "url", F.concat(F.lit("https://"), "site", F.lit(".example/p/"), key.cast("string")))
    none = F.lit(None).cast("double")
    products = part.select("p_partkey", "url", F.lit("").alias("price"), F.when(key % 3 != 0, F.col("p_retailprice")).otherwise(none).alias("price_value"))
    variants = part.select(
        "p_partkey", "url", F.posexplode(F.array(F.lit("sid=SLOTTED"), F.lit("sid=EXPRESS"), F.lit("sid=OTHER"))).alias("i", "param"), "p_retailprice",
    ).select("p_partkey", "url", "param", F.lit("").alias("price"),
             F.when((F.col("p_partkey") % 5 != 0) & (F.col("i") < 2), F.col("p_retailprice") + F.col("i") + 1).otherwise(none).alias("price_value"))
    preferred = part.where(key % 25 % 2 == 0).select(F.concat("site", F.lit(".example")).alias("host"), F.lit("sid=EXPRESS").alias("preferred_param")).distinct()
    ranks = F.create_map(F.lit("sid=SLOTTED"), F.lit(0), F.lit("sid=EXPRESS"), F.lit(1))
    out = FI.recover_missing_price(products, variants, ranks, preferred)
    return out.select("p_partkey", "price_value", "recovered")


@query("probe_urls", """SELECT concat('https://h.example/p/', p_partkey, '?sid=', p.v) AS probe_url, p.rank AS rank FROM part
CROSS JOIN (VALUES (0, 'SLOTTED'), (1, 'EXPRESS')) p(rank, v) WHERE p_partkey % 3 = 0""")
def probe_urls(spark, sf):
    key = F.col("p_partkey")
    products = table(spark, sf, "part").select(
        F.concat(F.lit("https://h.example/p/"), key.cast("string")).alias("url"), F.lit("").alias("price"),
        F.when(key % 3 != 0, F.col("p_retailprice")).alias("price_value"))
    params = F.array(*[F.create_map(F.lit("sid"), F.lit(v)) for v in ("SLOTTED", "EXPRESS")])
    return FI.probe_urls(products, params).select("probe_url", "rank")


@query("run_progress", """SELECT count(*) AS current, 2 * count(*) AS total,
  round(count(*) * (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / count(*), 0) AS eta FROM events""")
def run_progress_query(spark, sf):
    total = F.count(F.lit(1)) * 2
    done = run_progress(table(spark, sf, "events").select("ts"), total)
    return done.withColumn("eta", F.round("eta", 0))


@query("read_scrape_log", """SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS level,
  concat('note ', event_id, ' - ', CASE event_type WHEN 'signup' THEN 'run finished' ELSE 'x' END) AS message,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'signup' THEN 'success' ELSE 'plain' END AS severity FROM events""")
def read_scrape_log(spark, sf):
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), F.when(kind == "error", "ERROR").when(kind == "click", "WARNING").otherwise("INFO"),
        F.lit(" - note "), number, F.lit(" - "), F.when(kind == "signup", "run finished").otherwise("x"),
    )
    path = scratch_path(spark, "run-log")
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    parsed = SC.read_scrape_log(spark, path)
    return parsed.select(F.regexp_extract("message", r"^note (\d+)", 1).cast("long").alias("event_id"), "level", "message", "severity")
