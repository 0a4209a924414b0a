"""Queries over web pages: text and URL functions, links, and product records of part pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import money as M
from shelfmark.functions import text as T
from shelfmark.functions import urls as U
from shelfmark.functions.paths import safe_filename, safe_path_segment
from shelfmark.operators import discovery as D
from shelfmark.operators import elements as E
from shelfmark.operators import extract as P
from shelfmark.operators import images as I
from shelfmark.operators import jsonld as J
from shelfmark.operators.rules import selectors_of
from shelfmark.plans.registry import query
from shelfmark.plans.tables import PARSED_SQL, part_pages, table, write_arrays
from shelfmark.runtime import scratch_path, spread
from shelfmark.sources import crawl as SC

# What the driver's pages hold of entities, decoded.
DECODED = "replace(replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"
HOST_SQL = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
PATH_SQL = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def pages(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "url", "html"))


def _each(name, sql_value, column, source="pages", key="page_id"):
    """Register a per-row query ``(key, value)``."""

    @query(name, sql_value and f"SELECT {key}, {sql_value} AS value FROM {source}")
    def run(spark, sf):
        return table(spark, sf, source).select(key, column().alias("value"))

    return run


def _url():
    return F.col("url")


TOKENS = "'" + "', '".join(U.NON_PRODUCT_TOKENS) + "'"
SUFFIXES = "'" + "', '".join(U.ASSET_SUFFIXES) + "'"
HINTS = "'" + "', '".join(U.PRODUCT_HINTS) + "'"
LISTINGS = "'" + "', '".join(U.LISTING_HINTS) + "'"
SEGMENTS = "list_filter(string_split({0}, '/'), lambda s: s <> '')"


def scrapable_sql(path):
    """The scrapable-page rule on a path without a front controller."""
    parts = SEGMENTS.format(path)
    return f"""(NOT list_bool_or(list_transform([{SUFFIXES}], lambda s: ends_with(lower({path}), s)))
      AND NOT list_bool_or(list_transform([{TOKENS}], lambda s: contains(lower({path}), s)))
      AND len({parts}) > 0 AND NOT (len({parts}) = 1 AND length({parts}[1]) <= 3)
      AND NOT (len({parts}) = 1 AND lower({parts}[1]) IN ('shop', 'store', 'products', 'catalogue', 'catalog')))"""


_each("host_of", HOST_SQL, lambda: U.host_of(_url()))
_each("base_url", "regexp_extract(url, '^[a-z]+://[^/?#]*')", lambda: U.base_url(_url()))
_each("site_name", f"regexp_replace({HOST_SQL}, '^www[.]', '')", lambda: U.site_name(_url()))
_each("html_cache_key", "sha1(url)", lambda: U.html_cache_key(_url()))
_each("is_scrapable_page", scrapable_sql(PATH_SQL), lambda: U.is_scrapable_page(_url()))
_each("is_archive_root", f"len({SEGMENTS.format(PATH_SQL)}) = 0", lambda: U.is_archive_root(_url()))
_each("has_product_hint", f"list_bool_or(list_transform([{HINTS}], lambda s: contains(lower(url), s)))",
      lambda: U.has_product_hint(_url()))
_each("looks_like_listing", f"list_bool_or(list_transform([{LISTINGS}], lambda s: contains(lower(url), s)))",
      lambda: U.looks_like_listing(_url()))
_each("page_segments", f"array_to_string({SEGMENTS.format(PATH_SQL)}, '|')",
      lambda: F.array_join(U.page_segments(U.url_path(F.concat(F.lit("http://h/index.php"), U.url_path(_url())))), "|"))
_each("absolutize_url", "concat(regexp_extract(url, '^[a-z]+://[^/?#]*'), '/img/', page_id, '.jpg')",
      lambda: U.absolutize_url(F.concat(F.lit("../../../x/../img/./"), F.col("page_id").cast("string"), F.lit(".jpg")), _url()))
_each("normalize_url", "concat('https://h.example/p%20', page_id, '/%C3%A9?q=a%20b&r=', page_id)",
      lambda: U.normalize_url(F.concat(
          F.lit(" https://h.example/p "), F.col("page_id").cast("string"), F.lit("/é?q=a b&r="), F.col("page_id").cast("string"))))
_each("with_params", "concat('https://h.example/p?a=', page_id, '&sid=NEW+ONE&b=#f')",
      lambda: U.with_params(
          F.concat(F.lit("https://h.example/p?a="), F.col("page_id").cast("string"), F.lit("&sid=OLD&b=#f")),
          F.create_map(F.lit("sid"), F.lit("NEW ONE"))))
_each("is_junk_image", "page_id % 3 = 0",
      lambda: U.is_junk_image(F.concat(F.when(F.col("page_id") % 3 == 0, "/Placeholder/").otherwise("/img/"), F.col("page_id").cast("string"))))
_each("largest_from_srcset", "concat('/l', page_id, '.jpg')",
      lambda: U.largest_from_srcset(F.concat(
          F.lit("/s.jpg 300w, /l"), F.col("page_id").cast("string"), F.lit(".jpg 900w,/t.jpg 900w, /x.jpg 2x, /bad.jpg bw"))))
_each("safe_path_segment",
      "CASE WHEN page_id % 2 = 0 THEN concat('a_b_', page_id) ELSE concat('l', repeat('o', 32), '_', substr(sha1(concat('l', repeat('o', 60), ' ', page_id)), 1, 6)) END",
      lambda: safe_path_segment(
          F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" a/b: "), F.col("page_id").cast("string"), F.lit("?")))
          .otherwise(F.concat(F.lit("l"), F.repeat(F.lit("o"), 60), F.lit(" "), F.col("page_id").cast("string"))), 40))
_each("safe_filename", "concat('my photo+', page_id, '_.jpg')",
      lambda: safe_filename(F.concat(F.lit("https://x.example/a/my%20photo+"), F.col("page_id").cast("string"), F.lit("%C3%A9.jpg?v=2"))))
_each("raw_description", "replace(html, '<br>', chr(10))", lambda: T.raw_description(F.col("html")))
_each("xml_escape", "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')", lambda: T.xml_escape(F.col("html")))
_each("html_escape", "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')",
      lambda: T.html_escape(F.col("html")))
_each("unescape_html", DECODED.format(DECODED.format("html")), lambda: T.unescape_html(F.col("html")))
_each("clean_html",
      "trim(regexp_replace(" + DECODED.format(
          "regexp_replace(regexp_replace(html, '(?i)<(br|/p|/li|div[^>]*)>', chr(10), 'g'), '<[^>]+>', '', 'g')")
      + ", '\\n\\s*\\n', chr(10), 'g'), concat(' ', chr(10)))", lambda: T.clean_html(F.col("html")))
_each("has_content", "page_id % 2 = 1",
      lambda: T.has_content(F.when(F.col("page_id") % 2 == 1, F.col("html")).otherwise("<p>&nbsp; </p>")))
_each("comparison_key", f"regexp_replace(lower({DECODED.format(DECODED.format('html'))}), '[^a-z0-9]', '', 'g')",
      lambda: T.comparison_key(F.col("html")))
_each("html_to_text", "concat('a & b', chr(10), page_id, chr(10), 'c')",
      lambda: T.html_to_text(F.concat(
          F.lit("<p> a &amp; b</p><!-- x --><script>no</script><div>"), F.col("page_id").cast("string"), F.lit("<br> c </div>"))))
_each("html_to_markdown", "concat('## T', page_id, chr(10), chr(10), 'a **b** [c](u)', chr(10), chr(10), '* x', chr(10), '* y')",
      lambda: T.html_to_markdown(F.concat(
          F.lit("<h2>T"), F.col("page_id").cast("string"), F.lit('</h2><p>a <b>b</b> <a href="u">c</a></p><ul><li>x</li><li>y</li></ul>'))))
_each("clean_text", "trim(regexp_replace(text, '\\s+', ' ', 'g'))", lambda: T.clean_text(F.col("text")), "documents", "doc_id")

AMOUNT = "CASE WHEN {0} = floor({0}) THEN format('{{:,}}', CAST({0} AS BIGINT)) ELSE regexp_replace(format('{{:,.2f}}', {0}), '0$', '') END"


def _price_text():
    return F.concat(F.lit(" Now KSh "), F.format_number("o_totalprice", 2), F.lit("/="))


_each("to_number", "o_totalprice", lambda: M.to_number(_price_text()), "orders", "o_orderkey")
_each("format_price", "concat('$ ', " + AMOUNT.format("o_totalprice") + ")",
      lambda: M.format_price(F.col("o_totalprice"), F.lit("usd")), "orders", "o_orderkey")
_each("currency_symbols", "CASE o_orderpriority WHEN '1-URGENT' THEN '€' WHEN '2-HIGH' THEN 'KSh' WHEN '3-MEDIUM' THEN 'XYZ' ELSE '' END",
      lambda: M.currency_symbols(F.when(F.col("o_orderpriority") == "1-URGENT", "eur").when(F.col("o_orderpriority") == "2-HIGH", "KES")
                                 .when(F.col("o_orderpriority") == "3-MEDIUM", "xyz")), "orders", "o_orderkey")


@query("split_price_text", "SELECT o_orderkey, 'KES' AS currency, o_totalprice AS value FROM orders")
def split_price_text(spark, sf):
    parts = M.split_price_text(_price_text())
    return table(spark, sf, "orders").select("o_orderkey", parts.alias("p")).select("o_orderkey", "p.currency", "p.value")


@query("float_text", "SELECT o_orderkey, CAST(o_totalprice * 1000 AS VARCHAR) AS value FROM orders")
def float_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.float_text(F.col("o_totalprice") * 1000).alias("value"))


# ── Links ─────────────────────────────────────────────────────────────────

ANCHORS_SQL = f"""
raw AS (
  SELECT page_id, url AS page_url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root,
    unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>', '', 'g'),
      '<a href="([^"]*)"', 1)) AS href FROM pages),
anchors AS (
  SELECT page_id, page_url, concat(root, path) AS href, path FROM (
    SELECT *, regexp_replace({DECODED.format('href')}, '[?#].*$', '') AS path FROM raw))"""


@query("extract_links", f"WITH {ANCHORS_SQL} SELECT page_url, href FROM anchors WHERE {scrapable_sql('path')}")
def extract_links(spark, sf):
    return D.extract_links(pages(spark, sf)).select("page_url", "href")


@query("link_frontier", f"""WITH {ANCHORS_SQL} SELECT DISTINCT {HOST_SQL.replace('url', 'page_url', 1)} AS site, href AS url
FROM anchors WHERE {scrapable_sql('path')} AND href NOT IN (SELECT href FROM anchors WHERE page_url LIKE 'https:%')""")
def link_frontier(spark, sf):
    """Targets of all pages that no page fetched over https has shown yet."""
    seen = pages(spark, sf).where("url LIKE 'https:%'")
    links = D.extract_links(pages(spark, sf)).withColumn("site", U.host_of(F.col("page_url")))
    visited = D.extract_links(seen).select(U.host_of(F.col("page_url")).alias("site"), F.col("href").alias("url"))
    return D.link_frontier(links, visited)


@query("page_title", f"""
SELECT page_id, trim(regexp_replace({DECODED.format("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")}, '\\s+', ' ', 'g')) AS title,
  'h1' AS source FROM pages""")
def page_title(spark, sf):
    """The driver's own pages have no structured data: their first heading names them."""
    facts = P.extract_title(P.page_facts(pages(spark, sf)))
    return facts.select("page_id", "title", F.col("by_title").alias("source"))


# ── Product records of part pages ─────────────────────────────────────────

PARSED = "WITH " + PARSED_SQL


def facts(spark, sf):
    return P.page_facts(part_pages(spark, sf))


@query("jsonld_payloads", "SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN 1 ELSE 0 END AS n FROM part")
def jsonld_payloads(spark, sf):
    return part_pages(spark, sf).select("p_partkey", F.size(J.jsonld_payloads(F.col("html"))).alias("n"))


def _nodes(spark, sf):
    return part_pages(spark, sf).select("p_partkey", J.jsonld_nodes(J.jsonld_payloads(F.col("html"))).alias("nodes"))


@query("jsonld_nodes", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n FROM part")
def jsonld_nodes(spark, sf):
    return _nodes(spark, sf).select("p_partkey", F.size("nodes").alias("n"))


@query("type_names", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ';product;breadcrumblist'
  WHEN 1 THEN 'thing,product;organization' WHEN 2 THEN 'product' ELSE '' END AS types FROM part""")
def type_names(spark, sf):
    """Types in visiting order: lists and graphs last to first."""
    names = F.transform("nodes", lambda n: F.array_join(J.type_names(n), ","))
    return _nodes(spark, sf).select("p_partkey", F.array_join(names, ";").alias("types"))


@query("membership", "SELECT count(*) AS n FROM part WHERE p_partkey % 6 < 3")
def membership(spark, sf):
    wanted = F.array(*[F.lit(t) for t in J.PRODUCT_TYPES])
    return _nodes(spark, sf).where(
        F.exists("nodes", lambda n: F.arrays_overlap(J.type_names(n), wanted))
    ).agg(F.count(F.lit(1)).alias("n"))


@query("best_product_node", "SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN p_name ELSE '' END AS name FROM part")
def best_product_node(spark, sf):
    best = _nodes(spark, sf).select("p_partkey", J.best_product_node(F.col("nodes")).alias("node"))
    return best.select("p_partkey", J.node_text(F.col("node"), "name").alias("name"))


@query("offers_summary", """SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN p_retailprice END AS price_value,
  CASE p_partkey % 6 WHEN 0 THEN 'usd' WHEN 2 THEN 'EUR' ELSE '' END AS currency,
  CASE p_partkey % 6 WHEN 0 THEN 'InStock' WHEN 2 THEN 'OutOfStock' ELSE '' END AS availability FROM part""")
def offers_summary(spark, sf):
    best = _nodes(spark, sf).select("p_partkey", J.best_product_node(F.col("nodes")).alias("node"))
    return best.select("p_partkey", J.offers_summary(F.col("node")).alias("o")).select(
        "p_partkey", "o.price_value", F.coalesce("o.currency", F.lit("")).alias("currency"),
        F.coalesce("o.availability", F.lit("")).alias("availability"),
    )


@query("first_str", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat(p_brand, ' &amp; Co')
  WHEN 1 THEN concat('nation-', p_partkey % 25) ELSE '' END AS brand FROM part""")
def first_str(spark, sf):
    best = _nodes(spark, sf).select("p_partkey", J.best_product_node(F.col("nodes")).alias("node"))
    return best.select("p_partkey", J.node_text(F.col("node"), "brand").alias("brand"))


@query("jsonld_breadcrumbs", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0
  THEN concat('Home|', p_brand, '|', p_type, ' &amp; more|', p_name) ELSE '' END AS trail FROM part""")
def jsonld_breadcrumbs(spark, sf):
    return _nodes(spark, sf).select("p_partkey", F.array_join(J.jsonld_breadcrumbs(F.col("nodes")), "|").alias("trail"))


@query("clean_breadcrumbs", """SELECT p_partkey, concat(p_brand, '|', p_type) AS trail FROM part""")
def clean_breadcrumbs(spark, sf):
    names = F.array(F.lit(" Home "), F.lit("Shop"), F.col("p_brand"), F.lit("..."), F.upper("p_brand"), F.col("p_type"), F.upper("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(P.clean_breadcrumbs(names, F.col("p_name")), "|").alias("trail")
    )


@query("page_elements", """
SELECT p_partkey, t.tag, t.n FROM part JOIN (VALUES
  (0, 'title', 1), (1, 'title', 1), (2, 'title', 1), (3, 'title', 1), (4, 'title', 1), (5, 'title', 1),
  (3, 'h1', 1), (3, 'img', 3), (3, 'a', 2), (4, 'meta', 5), (5, 'meta', 1), (5, 'img', 1)) t(shape, tag, n)
ON p_partkey % 6 = t.shape""")
def page_elements(spark, sf):
    found = part_pages(spark, sf).select("p_partkey", F.explode(E.element_array(F.col("html"))).alias("e"))
    kept = found.where(F.col("e.tag").isin("title", "h1", "img", "a", "meta"))
    return kept.groupBy("p_partkey", F.col("e.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("apply_selector_rules", """
SELECT concat('https://www.nation-', p_partkey % 25, '.example/item/', p_partkey) AS url, r.field, r.selector,
  CASE r.field WHEN 'title' THEN p_name WHEN 'breadcrumbs' THEN concat('Home / ', p_type, ' Phones')
    WHEN 'sku' THEN concat(CASE WHEN r.shape = 3 THEN 'S-' ELSE 'U-' END, p_partkey)
    WHEN 'price' THEN concat('KSh ', format('{:,.2f}', p_retailprice)) WHEN 'short_description' THEN concat('Short ', p_name)
    WHEN 'region' THEN concat(p_name, ' x U-', p_partkey) ELSE 'Long' END AS text
FROM part JOIN (VALUES (3, 'title', 'h1.product_title'), (3, 'price', '.summary .price .woocommerce-Price-amount bdi'),
  (3, 'breadcrumbs', '.woocommerce-breadcrumb'), (3, 'sku', '.sku'), (5, 'sku', '[itemprop="sku"]'),
  (3, 'short_description', '.woocommerce-product-details__short-description'), (3, 'long_description', '#tab-description'),
  (5, 'region', '[itemtype*="Product"]')) r(shape, field, selector) ON p_partkey % 6 = r.shape""")
def apply_selector_rules(spark, sf):
    found = E.apply_selector_rules(E.page_elements(part_pages(spark, sf)), E.selector_table(spark))
    return found.select("url", "field", "selector", T.clean_text(F.col("text")).alias("text"))


@query("user_selector_rules", """
SELECT concat('https://www.nation-', p_partkey % 25, '.example/item/', p_partkey) AS url, r.field, r.selector,
  CASE r.field WHEN 'title' THEN p_name ELSE concat(CASE WHEN r.shape = 3 THEN 'S-' ELSE 'U-' END, p_partkey) END AS text
FROM part JOIN (VALUES (3, 'title', 'h1'), (3, 'sku', '.sku'), (5, 'sku', '[itemprop="sku"]')) r(shape, field, selector) ON p_partkey % 6 = r.shape""")
def user_selector_rules(spark, sf):
    """A user's rule table before the built-in selectors; the fields that it changes."""
    own = spark.createDataFrame([("title", 0, "h1"), ("sku", 1, '[itemprop="sku"]'), ("sku", 2, ".article b")], "field string, rank int, selector string")
    selectors = selectors_of(own)
    found = E.apply_selector_rules(E.page_elements(part_pages(spark, sf), selectors), E.selector_table(spark, selectors))
    return found.where("field in ('title', 'sku')").select("url", "field", "selector", T.clean_text(F.col("text")).alias("text"))


@query("first_layer", """SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 'css' WHEN 4 THEN 'opengraph' WHEN 5 THEN 'microdata'
  ELSE 'jsonld' END AS layer FROM part""")
def first_layer(spark, sf):
    titled = P.extract_title(facts(spark, sf))
    return titled.select("p_partkey", F.substring_index("by_title", ":", 1).alias("layer"))


@query("breadcrumbs_from_markup", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 3 THEN concat('Home|', p_type, ' Phones') ELSE '' END AS names,
  CASE WHEN p_partkey % 6 = 3 THEN 'css:.woocommerce-breadcrumb' ELSE '' END AS source FROM part""")
def breadcrumbs_from_markup(spark, sf):
    found = part_pages(spark, sf).select("p_partkey", E.element_array(F.col("html")).alias("el")).select(
        "p_partkey", P.breadcrumbs_from_markup(F.col("el")).alias("m")
    )
    return found.select(
        "p_partkey", F.coalesce(F.array_join("m.names", "|"), F.lit("")).alias("names"),
        F.coalesce("m.source", F.lit("")).alias("source"),
    )


@query("meta_values", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 4 THEN p_name ELSE '' END AS title,
  CASE WHEN p_partkey % 6 = 4 THEN concat('/img/', p_partkey, '.jpg?v=1') ELSE '' END AS images FROM part""")
def meta_values(spark, sf):
    metas = part_pages(spark, sf).select("p_partkey", E.element_array(F.col("html")).alias("el")).select(
        "p_partkey", E.of_tag(F.col("el"), "meta").alias("metas")
    )
    return metas.select(
        "p_partkey", E.meta_value(F.col("metas"), "og:title", "twitter:title").alias("title"),
        F.array_join(E.meta_values(F.col("metas"), "og:image", "twitter:image"), "|").alias("images"),
    )


@query("microdata_values", """SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN p_name ELSE '' END AS name,
  CASE WHEN p_partkey % 6 = 5 THEN printf('%.2f', p_retailprice) ELSE '' END AS price,
  CASE WHEN p_partkey % 6 = 5 THEN concat('//cdn.example/', p_partkey, '.png') ELSE '' END AS image FROM part""")
def microdata_values(spark, sf):
    found = part_pages(spark, sf).select("p_partkey", E.element_array(F.col("html")).alias("el")).select(
        "p_partkey", E.microdata_values(F.col("el"), "name", "price", "image").alias("m")
    )
    return found.select("p_partkey", *[F.col("m")[k].alias(k) for k in ("name", "price", "image")])


@query("extract_title", PARSED + " SELECT p_partkey, p_name AS title, by_title AS source FROM parsed")
def extract_title(spark, sf):
    return P.extract_title(facts(spark, sf)).select("p_partkey", "title", F.col("by_title").alias("source"))


@query("extract_price", PARSED + """
SELECT p_partkey, p_retailprice AS price_value, currency,
  trim(concat(symbol, ' ', CASE WHEN shape = 3 THEN format('{:,.2f}', p_retailprice) ELSE amount END)) AS price,
  CASE shape WHEN 3 THEN 'css:.summary .price .woocommerce-Price-amount bdi' WHEN 4 THEN 'opengraph' WHEN 5 THEN 'microdata'
    ELSE 'jsonld' END AS source FROM parsed""")
def extract_price(spark, sf):
    priced = P.extract_price(facts(spark, sf))
    return priced.select("p_partkey", "price_value", "currency", "price", F.col("by_price").alias("source"))


@query("extract_availability", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'InStock' WHEN 2 THEN 'OutOfStock'
    WHEN 5 THEN 'LimitedAvailability' ELSE '' END AS availability,
  CASE p_partkey % 6 WHEN 0 THEN true WHEN 2 THEN false WHEN 5 THEN true END AS in_stock FROM part""")
def extract_availability(spark, sf):
    return P.extract_availability(facts(spark, sf)).select("p_partkey", "availability", "in_stock")


TRAIL = """CASE p_partkey % 6 WHEN 0 THEN concat(p_brand, '|', p_type, ' & more') WHEN 3 THEN concat(p_type, ' Phones') ELSE '' END"""


@query("extract_categories", f"SELECT p_partkey, {TRAIL} AS categories FROM part")
def extract_categories(spark, sf):
    found = P.extract_categories(P.extract_title(facts(spark, sf)))
    return found.select("p_partkey", F.array_join("categories", "|").alias("categories"))


BRAND = """CASE p_partkey % 6 WHEN 0 THEN concat(p_brand, ' & Co') WHEN 3 THEN p_type ELSE regexp_extract(p_name, '^([^ ]*)', 1) END"""


@query("extract_brand", f"SELECT p_partkey, {BRAND} AS brand FROM part")
def extract_brand(spark, sf):
    """Shape 1 states the store's own name, which is no brand."""
    found = P.extract_brand(P.extract_categories(P.extract_title(facts(spark, sf))))
    return found.select("p_partkey", "brand")


SKU = """CASE p_partkey % 6 WHEN 0 THEN concat('P-', p_partkey) WHEN 1 THEN concat('M-', p_partkey)
  WHEN 3 THEN concat('S-', p_partkey) WHEN 5 THEN concat('U-', p_partkey) ELSE '' END"""


@query("extract_sku", f"SELECT p_partkey, {SKU} AS sku FROM part")
def extract_sku(spark, sf):
    return P.extract_sku(facts(spark, sf)).select("p_partkey", "sku")


SHORT = """CASE p_partkey % 6 WHEN 2 THEN concat('<p>About ', p_name, '</p>')
  WHEN 3 THEN concat('<div class="woocommerce-product-details__short-description"><p>Short ', p_name, '</p></div>')
  WHEN 4 THEN concat('<p>Say &lt;', p_name, '&gt;</p>') ELSE '' END"""
LONG = """CASE WHEN p_partkey % 6 = 3 THEN '<div id="tab-description"><p>Long</p></div>' ELSE '' END"""


@query("extract_descriptions", f"SELECT p_partkey, {SHORT} AS short_description, {LONG} AS long_description FROM part")
def extract_descriptions(spark, sf):
    found = P.extract_descriptions(facts(spark, sf))
    return found.select("p_partkey", "short_description", "long_description")


ROOT_URL = "concat('https://www.nation-', p_partkey % 25, '.example/img/', p_partkey)"
IMAGES = f"""CASE p_partkey % 6 WHEN 0 THEN concat({ROOT_URL}, '.jpg|', {ROOT_URL}, '-b.jpg')
  WHEN 3 THEN concat({ROOT_URL}, '-300x300.jpg|', {ROOT_URL}, '-z.jpg') WHEN 4 THEN concat({ROOT_URL}, '.jpg')
  WHEN 5 THEN concat('https://cdn.example/', p_partkey, '.png') ELSE '' END"""


@query("extract_images", f"SELECT p_partkey, {IMAGES} AS images FROM part")
def extract_images(spark, sf):
    found = P.extract_image_fields(facts(spark, sf))
    return found.select("p_partkey", F.array_join("images", "|").alias("images"))


@query("array_caps", "SELECT p_partkey, p_size AS n_all, least(p_size, 30) AS n FROM part")
def array_caps(spark, sf):
    """All images, and the first thirty for a caller who asks for so many; the operator has no limit."""
    many = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda n: F.concat(F.lit("/i/"), n.cast("string"), F.lit(".jpg")))
    kept = I.dedupe_image_variants(many)
    return spread(table(spark, sf, "part")).select("p_partkey", F.size(kept).alias("n_all"), F.size(F.slice(kept, 1, 30)).alias("n"))


@query("image_from_tag", f"""
SELECT p_partkey, pos, CASE pos WHEN 0 THEN '' WHEN 1 THEN concat({ROOT_URL}, '-300x300.jpg') ELSE concat({ROOT_URL}, '-z.jpg') END AS source
FROM part CROSS JOIN (VALUES (0), (1), (2)) t(pos) WHERE p_partkey % 6 = 3
UNION ALL SELECT p_partkey, 0, concat('https://cdn.example/', p_partkey, '.png') FROM part WHERE p_partkey % 6 = 5""")
def image_from_tag(spark, sf):
    tags = part_pages(spark, sf).select(
        "p_partkey", I.image_tags(E.element_array(F.col("html")), F.col("url")).alias("tags")
    )
    return tags.select("p_partkey", F.posexplode("tags").alias("pos", "t")).select("p_partkey", "pos", "t.source")


@query("dedupe_image_variants", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('/a', p_partkey, '.jpg|/b-20x30.jpg')
  WHEN 1 THEN concat('/a', p_partkey, '-600x600.jpg|/b-20x30.jpg') ELSE '/b-20x30.jpg' END AS images FROM part""")
def dedupe_image_variants(spark, sf):
    key = F.col("p_partkey")
    stem = F.concat(F.lit("/a"), key.cast("string"))
    many = F.array(
        F.when(key % 3 != 2, F.concat(stem, F.lit("-300x300.jpg"))), F.lit("/b-20x30.jpg"),
        F.when(key % 3 == 0, F.concat(stem, F.lit(".jpg"))),
        F.when(key % 3 != 2, F.concat(stem, F.lit("-600x600.jpg"))), F.lit("/b-30x20.jpg"), F.lit(""),
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(I.dedupe_image_variants(many), "|").alias("images"))


@query("parse_products", PARSED + f"""
SELECT url, p_name AS title, {BRAND} AS brand, {TRAIL} AS categories, {IMAGES} AS images, {SHORT} AS short_description,
  {LONG} AS long_description, p_retailprice AS price_value, currency, {SKU} AS sku,
  CASE shape WHEN 0 THEN 'InStock' WHEN 2 THEN 'OutOfStock' WHEN 5 THEN 'LimitedAvailability' ELSE '' END AS availability,
  CASE shape WHEN 0 THEN true WHEN 2 THEN false WHEN 5 THEN true END AS in_stock, by_title FROM parsed""")
def parse_products(spark, sf):
    records = P.parse_products(part_pages(spark, sf))
    return records.select(
        "url", "title", "brand", F.array_join("categories", "|").alias("categories"),
        F.array_join("images", "|").alias("images"), "short_description", "long_description", "price_value",
        "currency", "sku", "availability", "in_stock", F.col("extracted_by")["title"].alias("by_title"),
    )


@query("parse_products_of_pages", f"""
SELECT page_id, trim(regexp_replace({DECODED.format("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")}, '\\s+', ' ', 'g')) AS title,
  CAST(NULL AS DOUBLE) AS price_value FROM pages""")
def parse_products_of_pages(spark, sf):
    """Whole records of the driver's own pages, which are no product pages."""
    return P.parse_products(pages(spark, sf)).select("page_id", "title", "price_value")


@query("failures", """
SELECT concat('https://www.nation-', p_partkey % 25, '.example/item/', p_partkey) AS url,
  CASE WHEN p_partkey % 10 = 3 THEN 'HTTP 404' ELSE 'no product data found in page' END AS reason
FROM part WHERE p_partkey % 10 IN (3, 4)""")
def failures(spark, sf):
    key = F.col("p_partkey")
    shown = part_pages(spark, sf).withColumn("html", F.when(key % 10 == 4, "<p>nothing</p>").otherwise(F.col("html")))
    fetched = shown.select(
        "url", F.when(key % 10 == 3, "permanent").otherwise("ok").alias("outcome"),
        F.when(key % 10 == 3, "HTTP 404").alias("reason"),
    )
    return P.failures(P.parse_products(shown.where(key % 10 != 3)), fetched)


@query("read_page_archive", """
SELECT url, min(page_id) AS page_id, length(arg_min(html, page_id)) AS chars FROM pages GROUP BY url""")
def read_page_archive(spark, sf):
    """Pages written one file each under the hash of their address; half of what is asked for is missing."""
    path = scratch_path(spark, "archive")
    stored = pages(spark, sf).groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    SC.write_page_archive(stored, path)
    asked = stored.select(F.explode(F.array("url", F.concat("url", F.lit("-gone")))).alias("url"), "page_id")
    found = SC.read_page_archive(spark, path, asked)
    return found.select("url", "page_id", F.length("html").cast("long").alias("chars"))


@query("read_url_queue", "SELECT DISTINCT url FROM pages")
def read_url_queue(spark, sf):
    path = scratch_path(spark, "queue")
    lines = pages(spark, sf).select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit("\t")), F.lit(" "))).alias("value"))
    lines.write.text(path)
    return SC.read_url_queue(spark, path).distinct()


@query("read_categories", "SELECT DISTINCT p_type AS category FROM part UNION SELECT DISTINCT p_brand FROM part")
def read_categories(spark, sf):
    """Indented arrays of names, a file for each size of part."""
    path = scratch_path(spark, "categories")
    names = table(spark, sf, "part").select("p_size", F.explode(F.array("p_type", "p_brand")).alias("name")).distinct()
    write_arrays(names, F.col("name"), F.col("p_size"), path)
    return SC.read_categories(spark, f"{path}/*").distinct()


@query("read_failures", "SELECT url, concat('HTTP ', 400 + page_id % 100, ', \"[{\\') AS reason FROM pages")
def read_failures(spark, sf):
    """Indented arrays of 500 neighbouring pages; reasons hold what arrays are made of."""
    path = scratch_path(spark, "failures")
    reason = F.concat(F.lit("HTTP "), (F.col("page_id") % 100 + 400).cast("string"), F.lit(', "[{\\'))
    write_arrays(pages(spark, sf), F.struct("url", reason.alias("reason")), F.floor(F.col("page_id") / 500), path)
    return SC.read_failures(spark, f"{path}/*")
