"""Inputs that Spark derives from the driver's tables, and the same inputs as SQL text.

Stores are the 25 nations; a product is a part, a line item is one scrape of its product, an
event is one fetch attempt on the host of its user. Everything grows with the tables it is read
from. Shapes rotate with arithmetic on keys, so that a plain query can say what to expect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions.text import html_escape
from shelfmark.runtime import shares, spread

# Unique per line item.
ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
]
EXTRA = {
    "l_shipdate": "timestamp", "l_orderkey": "long", "l_linenumber": "int", "l_partkey": "long",
    "l_suppkey": "long", "l_extendedprice": "double", "l_quantity": "double", "site": "string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _site(key: str) -> Column:
    return F.concat(F.lit("nation-"), (F.col(key) % 25).cast("string"))


def product_facts(spark, sf_dir, heavy: bool = False) -> DataFrame:
    """One row per part with the fields of its record that do not change between scrapes; for heavy work on all cores."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    part = spread(part) if heavy else part
    stores = nation.select(
        F.col("n_nationkey").cast("long").alias("_store"),
        F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")).alias("site"),
    )
    key = F.col("p_partkey")
    # One row a nation: 25 rows at any scale.
    return part.join(F.broadcast(stores), key % 25 == F.col("_store")).select(
        "p_partkey", "site",
        F.concat(F.lit("https://"), "site", F.lit(".example/product/"), key.cast("string")).alias("url"),
        F.when(key % 50 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.when(key % 40 == 0, "Unknown").otherwise(F.col("p_brand")).alias("brand"),
        F.array("p_type", F.substring_index("p_name", " ", -1)).alias("categories"),
        F.transform(
            F.sequence(F.lit(0), (F.col("p_size") % 3).cast("int")),
            lambda n: F.concat(
                F.lit("https://"), F.col("site"), F.lit(".example/img/"), key.cast("string"), F.lit("-"),
                n.cast("string"), F.lit(".jpg"),
            ),
        ).alias("images"),
        F.concat(F.lit("<p>"), "p_name", F.lit(" &amp; more</p><br>"), "p_type").alias("short_description"),
        F.concat(F.lit("P-"), key.cast("string")).alias("sku"),
        (key % 3).alias("_stock"),
    )


def product_log(spark, sf_dir) -> DataFrame:
    """One record per line item: the product log, with the columns of ``ORDER``."""
    lines = table(spark, sf_dir, "lineitem").select(*ORDER)
    # Both sides grow with the data and neither may be broadcast. A hot part of a small table is split
    # by AQE; in many partitions it is one task, whose sort may spill.
    facts, n = product_facts(spark, sf_dir), shares(lines)
    if n:
        lines, facts = lines.repartition(n, "l_partkey"), facts.repartition(n, "p_partkey")
    facts = facts.hint("merge")
    quantity = F.col("l_quantity").cast("long").cast("string")
    return lines.join(facts, F.col("l_partkey") == F.col("p_partkey")).select(
        "title", "brand", F.concat(F.lit("USD "), quantity).alias("price"), "url", "categories", "images",
        "short_description", F.lit("").alias("long_description"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_value"), F.lit("USD").alias("currency"),
        "sku",
        F.when(F.col("_stock") == 0, "InStock").when(F.col("_stock") == 1, "OutOfStock").otherwise("").alias("availability"),
        F.when(F.col("_stock") == 0, True).when(F.col("_stock") == 1, False).alias("in_stock"),
        "site", *ORDER,
    )


FACTS_SQL = """
facts AS (
  SELECT p_partkey, site, concat('https://', site, '.example/product/', p_partkey) AS url,
    CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END AS title,
    CASE WHEN p_partkey % 40 = 0 THEN 'Unknown' ELSE p_brand END AS brand,
    [p_type, regexp_extract(p_name, '([^ ]*)$', 1)] AS categories,
    list_transform(range(0, (p_size % 3) + 1),
      lambda n: concat('https://', site, '.example/img/', p_partkey, '-', n, '.jpg')) AS images,
    concat('<p>', p_name, ' &amp; more</p><br>', p_type) AS short_description,
    concat('P-', p_partkey) AS sku,
    CASE p_partkey % 3 WHEN 0 THEN 'InStock' WHEN 1 THEN 'OutOfStock' ELSE '' END AS availability,
    CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS in_stock
  FROM (SELECT part.*, replace(lower(n_name), '_', '-') AS site
        FROM part JOIN nation ON n_nationkey = p_partkey % 25))"""
LOG_SQL = FACTS_SQL + """,
log AS (
  SELECT facts.*, concat('USD ', CAST(l_quantity AS BIGINT)) AS price, '' AS long_description,
    l_extendedprice / l_quantity AS price_value, 'USD' AS currency, l_shipdate, l_orderkey,
    l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
  FROM lineitem JOIN facts ON l_partkey = p_partkey)"""
LATEST_SQL = LOG_SQL + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY l_shipdate DESC, l_orderkey DESC,
      l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn,
    first_value(l_shipdate) OVER w AS first_shipdate, first_value(l_orderkey) OVER w AS first_orderkey,
    first_value(l_linenumber) OVER w AS first_linenumber
  FROM log
  WINDOW w AS (PARTITION BY url ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_extendedprice, l_quantity)),
latest AS (SELECT * FROM ranked WHERE rn = 1)"""


# ── Pages of stores, made of parts ────────────────────────────────────────

# Six ways to say the same facts; a part's number picks one.
SHAPES = ("graph", "listed", "offers", "theme", "meta", "items")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _tag(name: str, *inner, **attributes) -> Column:
    """An element; underscores in attribute names stand for hyphens, content None for an element without end tag."""
    head = [x for k, v in attributes.items() for x in (f" {k.rstrip('_').replace('_', '-')}=\"", v, '"')]
    if inner and inner[0] is None:
        return _text(f"<{name}", *head, ">")
    return _text(f"<{name}", *head, ">", *inner, f"</{name}>")


def _object(**fields) -> Column:
    """A JSON object as Variant, so that objects of different fields can stand in one array; kind is its type."""
    values = [(F.lit(v) if isinstance(v, str) else v).alias("@type" if k == "kind" else k) for k, v in fields.items()]
    return F.to_variant_object(F.struct(*values))


def _script(value: Column) -> Column:
    return _tag("script", value, type="application/ld+json")


def _pictures(*names) -> list:
    return [_text("/img/", F.col("p_partkey").cast("string"), n) for n in names]


def _graph() -> Column:
    """Breadcrumbs from the last to the first, and a product whose texts are escaped for HTML."""
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    trail = [F.lit("Home"), brand, _text(kind, " &amp; more"), name]
    steps = [_object(kind="ListItem", position=F.lit(i), name=step) for i, step in reversed(list(enumerate(trail, 1)))]
    pictures = [_object(kind="ImageObject", url=u) for u in _pictures(".jpg", "-b.jpg")]
    sold = _object(price=_price(), priceCurrency="usd", availability="InStock")
    product = _object(
        kind="Product", sku=_text("P-", F.col("p_partkey").cast("string")), offers=F.array(sold), image=F.array(*pictures),
        brand=_text(brand, " &amp; Co"), name=name)
    return _script(F.to_json(F.struct(F.array(_object(kind="BreadcrumbList", itemListElement=F.array(*steps)), product).alias("@graph"))))


def _listed() -> Column:
    """A list with a comma too many; the store's own name stands where the brand should."""
    product = _object(
        kind=F.array(F.lit("Thing"), F.lit("schema:Product")), mpn=_text("M-", F.col("p_partkey").cast("string")), name=F.col("p_name"),
        manufacturer=F.array(F.col("p_brand")), brand=_site("p_partkey"),
        offers=_object(priceSpecification=_object(price=F.format_number("p_retailprice", 2))))
    return _script(_text("[", F.to_json(_object(kind="Organization", name="Store")), ",", F.to_json(product), ",]"))


def _offers() -> Column:
    """Offers of a range and of a single price."""
    low = _object(priceCurrency="EUR", lowPrice=F.col("p_retailprice") + 10)
    single = _object(availability="OutOfStock", price=F.col("p_retailprice"))
    return _script(F.to_json(_object(
        kind="http://schema.org/Product", offers=F.array(low, single), description=_text("About ", F.col("p_name")), name=F.col("p_name"))))


def _theme() -> Column:
    """Elements of a shop theme: pictures that load late, then what stands beside and above them."""
    number = F.col("p_partkey").cast("string")
    small, plain, large = _pictures("-300x300.jpg", ".jpg", "-z.jpg")
    pictures = [{"src": "/u/spacer.gif"}, {"data_src": small}, {"srcset": _text(plain, " 300w, ", large, " 900w")}]
    amount = _tag("span", _tag("bdi", "KSh&nbsp;", F.format_number("p_retailprice", 2)), class_="woocommerce-Price-amount")
    short = _tag("div", _tag("p", "Short ", F.col("p_name")), class_="woocommerce-product-details__short-description")
    return _text(
        _tag("div", *[_tag("img", None, **x) for x in pictures], class_="woocommerce-product-gallery__wrapper"),
        _tag("h1", html_escape(F.col("p_name")), class_="product_title entry-title"),
        _tag("section", short, _tag("p", amount, class_="price"), _tag("span", "S-", number, class_="sku"), class_="summary"),
        _tag("nav", _tag("a", "Home", href="/"), " / ", _tag("a", F.col("p_type"), " Phones", href="/c"), class_="woocommerce-breadcrumb"),
        _tag("div", _tag("p", "Long"), id="tab-description"),
    )


def _meta() -> Column:
    said = {
        "og:image": _text(*_pictures(".jpg"), "?v=1"), "og:description": _text("Say &lt;", F.col("p_name"), "&gt;"), "og:title": F.col("p_name"),
        "product:price:currency": "GBP", "product:price:amount": _price(),
    }
    return _text(*[_tag("meta", None, property=k, content=v) for k, v in said.items()])


def _items() -> Column:
    """Properties in attributes of elements of several kinds, and in their text."""
    number = F.col("p_partkey").cast("string")
    return _tag(
        "div",
        _tag("meta", None, itemprop="priceCurrency", content="kes"),
        _tag("span", F.col("p_name"), itemprop="name"),
        _tag("img", None, itemprop="image", src=_text("//cdn.example/", number, ".png")),
        _tag("b", "x", itemprop="price", content=_price()),
        _tag("span", "U-", number, itemprop="sku"),
        _tag("link", None, itemprop="availability", href="https://schema.org/LimitedAvailability"),
        itemscope="", itemtype="https://schema.org/Product",
    )


def _price() -> Column:
    return F.format_string("%.2f", F.col("p_retailprice"))


def part_pages(spark, sf_dir) -> DataFrame:
    """``(p_partkey, site, url, html)``: one product page per part, in the shape of its number."""
    made = {"graph": _graph, "listed": _listed, "offers": _offers, "theme": _theme, "meta": _meta, "items": _items}
    key = F.col("p_partkey")
    body = F.lit(None).cast("string")
    for i, shape in enumerate(SHAPES):
        body = F.when(key % len(SHAPES) == i, made[shape]()).otherwise(body)
    html = _text(
        "<!DOCTYPE html><html><head>", _tag("title", F.col("p_name"), " - Store"), "</head><body><!-- x -->", body,
        "<script>var a = '</p>';</script></body></html>",
    )
    site = _site("p_partkey")
    url = _text("https://www.", site, ".example/item/", key.cast("string"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", site.alias("site"), url.alias("url"), html.alias("html"))


# What a reader should find on those pages, as SQL.
PARSED_SQL = """
parsed AS (
  SELECT p_partkey, concat('https://www.nation-', p_partkey % 25, '.example/item/', p_partkey) AS url,
    p_partkey % 6 AS shape, p_name, p_type, p_brand, p_retailprice,
    CASE p_partkey % 6 WHEN 3 THEN 'css:h1.product_title' WHEN 4 THEN 'opengraph' WHEN 5 THEN 'microdata'
      ELSE 'jsonld' END AS by_title,
    CASE p_partkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN '' WHEN 2 THEN 'EUR' WHEN 3 THEN 'KES' WHEN 4 THEN 'GBP'
      ELSE 'KES' END AS currency,
    CASE p_partkey % 6 WHEN 0 THEN '$' WHEN 1 THEN '' WHEN 2 THEN '€' WHEN 4 THEN '£' ELSE 'KSh' END AS symbol,
    CASE WHEN p_retailprice = floor(p_retailprice) THEN format('{:,}', CAST(p_retailprice AS BIGINT))
      ELSE regexp_replace(format('{:,.2f}', p_retailprice), '0$', '') END AS amount
  FROM part)"""


# ── Fetch attempts, made of events ────────────────────────────────────────

ATTEMPT_ORDER = ["ts", "event_id"]
# What an event type stands for as a response.
STATUS_OF = {"view": 200, "click": 429, "signup": 404, "purchase": 503, "error": 500}


def attempts(spark, sf_dir) -> DataFrame:
    """``(event_id, ts, host, url, profile, status, headers, body)``: one response per event."""
    events = table(spark, sf_dir, "events")
    status = F.lit(500)
    for kind, code in STATUS_OF.items():
        status = F.when(F.col("event_type") == kind, code).otherwise(status)
    shape = F.col("event_id") % 5
    body = (
        F.when(status != 200, "")
        .when(shape == 0, "<title>Just a moment...</title>")
        .when(shape == 1, "short page")
        .when(shape == 2, "")
        .otherwise(F.repeat(F.lit("a page "), 60))
    )
    headers = F.when(
        status == 429,
        F.create_map(F.lit("Retry-After"), F.when(shape == 0, "soon").otherwise(F.round("value").cast("long").cast("string"))),
    ).otherwise(F.create_map(F.lit("Content-Type"), F.when(shape == 3, "application/json").otherwise("text/html")))
    return events.select(
        "event_id", "ts", F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
        F.concat(
            F.lit("https://host-"), F.col("user_id").cast("string"), F.lit("/p/"),
            (F.col("event_id") % 40).cast("string"),
        ).alias("url"),
        F.when(F.col("event_id") % 7 == 0, "safari").otherwise("chrome").alias("profile"),
        status.alias("status"), headers.alias("headers"), body.alias("body"), "value",
    )


ATTEMPTS_SQL = """
attempts AS (
  SELECT event_id, ts, concat('host-', user_id) AS host,
    concat('https://host-', user_id, '/p/', event_id % 40) AS url,
    CASE WHEN event_id % 7 = 0 THEN 'safari' ELSE 'chrome' END AS profile,
    CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'signup' THEN 404
      WHEN 'purchase' THEN 503 ELSE 500 END AS status,
    event_id % 5 AS shape, value FROM events),
judged AS (
  SELECT *,
    CASE WHEN status = 404 THEN 'permanent' WHEN status = 429 THEN 'throttled'
      WHEN status = 503 THEN 'fingerprint' WHEN status = 500 THEN 'transient'
      WHEN shape = 0 THEN 'fingerprint' WHEN shape IN (1, 2) THEN 'transient' ELSE 'ok' END AS outcome,
    CASE WHEN status <> 200 THEN concat('HTTP ', status) WHEN shape = 0 THEN 'bot challenge page'
      WHEN shape = 1 THEN 'suspiciously short HTML (10 bytes)' WHEN shape = 2 THEN 'empty response body' END AS reason
  FROM attempts)"""


def write_arrays(rows, value, chunk, path):
    """One indented JSON array of ``value`` for each chunk, in a folder of its own under ``path``."""
    arrays = rows.groupBy(chunk.alias("chunk")).agg(
        F.to_json(F.collect_list(value), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))
    arrays.select("value", "chunk").write.partitionBy("chunk").text(path)
