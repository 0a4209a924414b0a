"""Queries over the product log: one record per line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.paths import image_path, product_dir
from shelfmark.operators import catalogue as C
from shelfmark.operators import exports as X
from shelfmark.operators import files as FI
from shelfmark.plans.registry import query
from shelfmark.plans.tables import (
    EXTRA, FACTS_SQL, LATEST_SQL, LOG_SQL, ORDER, product_facts, product_log, table, write_arrays,
)
from shelfmark.runtime import scratch_path, stored
from shelfmark.schema import EXPORT_FIELDS, export_rows, normalize_records
from shelfmark.sources import logs as L

BY_POSITION = ["position"]


def latest(spark, sf, columns=None):
    """Current catalogue. ``columns`` names what is used of it: the others never enter the shuffle."""
    kept = None if columns is None else sorted({"url", *columns})
    log = product_log(spark, sf)
    return C.latest_per_url(log, ORDER, kept)


LATEST = "WITH " + LATEST_SQL
# The record of a URL sits where the URL is first seen; l_partkey settles equal places.
FIRST = "first_shipdate, first_orderkey, first_linenumber, l_partkey"


@query("latest_per_url", LATEST + """
SELECT site, url, title, brand, price, price_value,
  l_orderkey AS last_order, first_orderkey AS first_order FROM latest""")
def latest_per_url(spark, sf):
    columns = ["site", "title", "brand", "price", "price_value", "l_orderkey"]
    return latest(spark, sf, columns).select(
        "site", "url", "title", "brand", "price", "price_value",
        F.col("l_orderkey").alias("last_order"), F.col("position.first.l_orderkey").alias("first_order"),
    )


@query("catalogue_stats", LATEST + """
SELECT count(*) AS total_products,
  (SELECT count(DISTINCT c) FROM (SELECT unnest(categories) AS c FROM latest WHERE title <> '')) AS total_categories,
  count(DISTINCT CASE WHEN title <> '' AND brand <> 'Unknown' THEN brand END) AS total_brands,
  CAST(sum(CASE WHEN title <> '' THEN len(images) ELSE 0 END) AS BIGINT) AS total_images FROM latest""")
def catalogue_stats(spark, sf):
    return C.catalogue_stats(latest(spark, sf, ["title", "brand", "categories", "images"]))


@query("catalogue_stats_of_sites", "WITH " + FACTS_SQL + """
SELECT site, count(*) AS products, count(DISTINCT CASE WHEN title <> '' AND brand <> 'Unknown' THEN brand END) AS brands,
  CAST(sum(CASE WHEN title <> '' THEN len(images) ELSE 0 END) AS BIGINT) AS images FROM facts GROUP BY site""")
def catalogue_stats_of_sites(spark, sf):
    titled = C.has_title()
    facts = product_facts(spark, sf)
    # Two steps: values are made distinct with map-side combine before they are counted.
    per_brand = facts.groupBy(
        "site", F.when(titled & (F.col("brand") != "Unknown"), F.col("brand")).alias("b")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(titled, F.size("images")).otherwise(0)).alias("i"))
    return per_brand.groupBy("site").agg(
        F.sum("n").alias("products"), F.count("b").alias("brands"), F.sum("i").alias("images")
    )


@query("site_summary", LATEST + """
SELECT site, count(*) AS products,
  CAST(sum(CASE WHEN title = '' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  strftime(max(l_shipdate), '%Y-%m-%d') AS modified,
  site = (SELECT site FROM latest GROUP BY site ORDER BY max(l_shipdate) DESC, site LIMIT 1) AS active
FROM latest GROUP BY site
UNION ALL SELECT replace(lower(n_name), '_', '-'), 0, 0, NULL, false FROM nation
WHERE replace(lower(n_name), '_', '-') NOT IN (SELECT site FROM latest)""")
def site_summary(spark, sf):
    products = latest(spark, sf, ["site", "title", "l_shipdate"])
    stores = table(spark, sf, "nation").select(F.replace(F.lower("n_name"), F.lit("_"), F.lit("-")).alias("site"))
    changed = product_log(spark, sf).groupBy("site").agg(F.max("l_shipdate").alias("modified"))
    sites = stores.join(changed, "site", "left")
    out = C.site_summary(sites, products, products.where(~C.has_title()))
    return out.withColumn("modified", F.date_format("modified", "yyyy-MM-dd"))


@query("sites_by_modified", "WITH " + LOG_SQL + """
SELECT site, strftime(max(l_shipdate), '%Y-%m-%d') AS modified FROM log GROUP BY site""")
def sites_by_modified(spark, sf):
    changed = product_log(spark, sf).groupBy("site").agg(F.max("l_shipdate").alias("modified"))
    return C.newest_sites(changed).withColumn("modified", F.date_format("modified", "yyyy-MM-dd"))


@query("distinct_values", "WITH " + FACTS_SQL + " SELECT DISTINCT unnest(categories) AS value FROM facts")
def distinct_values(spark, sf):
    return C.distinct_values(product_facts(spark, sf), "categories")


@query("export_distinct_list", "WITH " + FACTS_SQL + """
SELECT DISTINCT trim(brand) AS "Brand Name" FROM facts WHERE brand <> 'Unknown' AND trim(brand) <> ''""")
def export_distinct_list(spark, sf):
    facts = product_facts(spark, sf)
    path = scratch_path(spark, "brands")
    X.export_distinct_list(facts, path, "brand", "Brand Name")
    return spark.read.option("header", True).csv(path)


@query("sorted_lists", "WITH " + FACTS_SQL + """
SELECT DISTINCT brand AS "Brand Name" FROM facts WHERE brand <> ''""")
def sorted_lists(spark, sf):
    return X.list_rows(product_facts(spark, sf), "brand", "Brand Name", drop_unknown=False)


@query("has_title", LATEST + " SELECT url, title FROM latest WHERE title <> ''")
def has_title(spark, sf):
    return latest(spark, sf, ["title"]).where(C.has_title()).select("url", "title")


@query("is_complete", LATEST + """
SELECT site, count(*) AS complete FROM latest WHERE title <> '' AND url <> '' GROUP BY site""")
def is_complete(spark, sf):
    return latest(spark, sf, ["site", "title"]).where(C.is_complete()).groupBy("site").agg(
        F.count(F.lit(1)).alias("complete")
    )


@query("search_products", LATEST + """
SELECT url, title, brand FROM latest WHERE title <> ''
  AND (contains(lower(title), 'red') OR contains(lower(short_description), 'red'))
  AND list_contains(categories, 'ECONOMY')""")
def search_products(spark, sf):
    found = latest(spark, sf, ["title", "brand", "categories", "short_description"])
    return C.search_products(found, "RED", "ECONOMY").select("url", "title", "brand")


PAGE_SQL = LATEST + f""", placed AS (
  SELECT *, row_number() OVER (ORDER BY {FIRST}) - 1 AS pos FROM latest WHERE title <> '')"""


@query("paginate", PAGE_SQL + " SELECT url, title, brand FROM placed WHERE pos BETWEEN 50 AND 74")
def paginate(spark, sf):
    titled = latest(spark, sf, ["title", "brand"]).where(C.has_title())
    return C.paginate(titled, 3, 25, BY_POSITION).select("url", "title", "brand")


@query("page_info", LATEST + """
SELECT count(*) AS total, 3 AS page, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages,
  3 < ceil(count(*) / 25) AS has_more FROM latest WHERE title <> ''""")
def page_info(spark, sf):
    return C.page_info(latest(spark, sf, ["title"]).where(C.has_title()), 3, 25)


SCRAPES_SQL = "WITH " + LOG_SQL + """, placed AS (
  SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice, l_quantity) - 1 AS pos, count(*) OVER () AS n FROM log)"""


@query("paginate_deep", SCRAPES_SQL + """
SELECT url, l_orderkey, l_linenumber FROM placed WHERE pos BETWEEN 34950 AND 34999""")
def paginate_deep(spark, sf):
    scrapes = product_log(spark, sf).select("url", *ORDER)
    return C.paginate(scrapes, 700, 50, ORDER).select("url", "l_orderkey", "l_linenumber")


@query("limit_urls", PAGE_SQL + " SELECT url FROM placed WHERE pos < 40")
def limit_urls(spark, sf):
    titled = latest(spark, sf, ["title"]).where(C.has_title())
    return C.limit_urls(titled, 40, BY_POSITION).select("url")


@query("limit_urls_large", SCRAPES_SQL + " SELECT url, l_orderkey, l_linenumber FROM placed WHERE pos < 20000")
def limit_urls_large(spark, sf):
    scrapes = product_log(spark, sf).select("url", *ORDER)
    return C.limit_urls(scrapes, 20_000, ORDER).select("url", "l_orderkey", "l_linenumber")


@query("log_tail", SCRAPES_SQL + " SELECT url, l_orderkey, l_linenumber FROM placed WHERE pos >= n - 100")
def log_tail(spark, sf):
    scrapes = product_log(spark, sf).select("url", *ORDER)
    return C.log_tail(scrapes, 100, ORDER).select("url", "l_orderkey", "l_linenumber")


DONE_SQL = """, done AS (
  SELECT DISTINCT facts.url FROM facts JOIN orders ON o_orderkey = p_partkey WHERE o_orderstatus = 'F')"""


def _done(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return product_facts(spark, sf).join(orders, F.col("p_partkey") == F.col("o_orderkey"), "left_semi")


@query("pending_urls", "WITH " + FACTS_SQL + DONE_SQL + """
SELECT site, url FROM facts WHERE url NOT IN (SELECT url FROM done)""")
def pending_urls(spark, sf):
    return C.pending_urls(product_facts(spark, sf).select("site", "url"), _done(spark, sf))


@query("difference", "WITH " + LOG_SQL + DONE_SQL + """
SELECT site, count(*) AS pending FROM log WHERE url NOT IN (SELECT url FROM done) GROUP BY site""")
def difference(spark, sf):
    """The anti-join keeps duplicates: every pending scrape counts."""
    scrapes = product_log(spark, sf).select("site", "url")
    return C.pending_urls(scrapes, _done(spark, sf)).groupBy("site").agg(F.count(F.lit(1)).alias("pending"))


@query("lookup_product", LATEST + """, refs AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat('https://nation-', o_orderkey % 25, '.example/product/', o_orderkey)
      ELSE concat('gone-', o_orderkey) END AS ref_url,
    concat(CASE WHEN o_orderkey % 2 = 0 THEN 'red' ELSE 'small' END, ' ',
      CASE o_orderkey % 3 WHEN 0 THEN 'widget' WHEN 1 THEN 'ring' ELSE 'nothing' END) AS ref_title FROM orders),
by_title AS (SELECT title AS ref_title, url, row_number() OVER (PARTITION BY title ORDER BY """ + FIRST + """) AS k FROM latest)
SELECT refs.ref_url, refs.ref_title, coalesce(u.url, t.url) AS url FROM refs
LEFT JOIN latest u ON u.url = refs.ref_url LEFT JOIN by_title t ON t.ref_title = refs.ref_title AND k = 1""")
def lookup_product(spark, sf):
    key = F.col("o_orderkey")
    refs = table(spark, sf, "orders").select(
        F.when(
            key % 3 == 0,
            F.concat(F.lit("https://nation-"), (key % 25).cast("string"), F.lit(".example/product/"), key.cast("string")),
        ).otherwise(F.concat(F.lit("gone-"), key.cast("string"))).alias("ref_url"),
        F.concat(
            F.when(key % 2 == 0, "red").otherwise("small"), F.lit(" "),
            F.when(key % 3 == 0, "widget").when(key % 3 == 1, "ring").otherwise("nothing"),
        ).alias("ref_title"),
    )
    found = C.lookup_product(latest(spark, sf, ["title"]), refs, "position")
    return found.select("ref_url", "ref_title", "url")


ROWS_SQL = """SELECT title, brand, price, url, array_to_string(categories, ' > ') AS categories,
  array_to_string(images, ' | ') AS images, {short} AS short_description, long_description,
  {price_value} AS price_value, currency, sku, availability,
  CASE WHEN in_stock THEN 'yes' WHEN NOT in_stock THEN 'no' ELSE '' END AS in_stock
FROM latest WHERE {where}"""
# Tags go, the entity is decoded and the two break lines collapse into one.
CLEAN_SQL = "concat(regexp_extract(short_description, '^<p>([^&]*)', 1), '& more', chr(10), regexp_extract(short_description, '<br>(.*)$', 1))"
NUMBER_SQL = "CAST(price_value AS VARCHAR)"


def _rounded(df):
    return df.withColumn("price_value", F.floor("price_value") + 0.25)


ROUND_LATEST = LATEST_SQL + ", rounded AS (SELECT * REPLACE (floor(price_value) + 0.25 AS price_value) FROM latest)"
FEED_SQL = "WITH " + ROUND_LATEST + " " + ROWS_SQL.replace("FROM latest", "FROM rounded")


@query("export_rows", FEED_SQL.format(short="short_description", price_value=NUMBER_SQL, where="true"))
def export_rows_query(spark, sf):
    return export_rows(_rounded(latest(spark, sf, EXPORT_FIELDS)))


@query("export_csv", FEED_SQL.format(short=CLEAN_SQL, price_value=NUMBER_SQL, where="title <> ''"))
def export_csv(spark, sf):
    path = scratch_path(spark, "csv")
    X.export_csv(_rounded(latest(spark, sf, EXPORT_FIELDS)), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.na.fill("")


@query("export_excel_rows", "SELECT " + ", ".join(f'{f} AS "{f.replace("_", " ").title()}"' for f in EXPORT_FIELDS)
       + " FROM (" + FEED_SQL.format(short=CLEAN_SQL, price_value=NUMBER_SQL, where="title <> ''") + ")")
def export_excel_rows(spark, sf):
    return X.excel_rows(_rounded(latest(spark, sf, EXPORT_FIELDS)))


@query("export_xml", FEED_SQL.format(short=CLEAN_SQL, price_value=NUMBER_SQL, where="title <> ''"))
def export_xml(spark, sf):
    path = scratch_path(spark, "xml")
    X.export_xml(_rounded(latest(spark, sf, EXPORT_FIELDS)), path)
    fields = ", ".join(f"{f} string" for f in EXPORT_FIELDS)
    back = spark.read.format("xml").option("rowTag", "product").option("ignoreSurroundingSpaces", False).schema(fields).load(path)
    return back.na.fill("")


@query("export_json", LATEST + f"""
SELECT url, title, {CLEAN_SQL} AS short_description, len(categories) AS n_categories, images[1] AS first_image FROM latest""")
def export_json(spark, sf):
    """All records, untitled ones too, with their lists."""
    path = scratch_path(spark, "json")
    X.export_json(latest(spark, sf, EXPORT_FIELDS).select(*EXPORT_FIELDS), path)
    back = spark.read.schema("url string, title string, short_description string, categories array<string>, images array<string>").json(path)
    return back.select(
        "url", "title", "short_description", F.size("categories").cast("long").alias("n_categories"),
        F.get("images", F.lit(0)).alias("first_image"),
    )


@query("export_bundle", LATEST + """, due AS (
  SELECT site, count(*) AS n, CAST(sum(CASE WHEN title <> '' THEN 1 ELSE 0 END) AS BIGINT) AS titled,
    count(DISTINCT CASE WHEN brand <> 'Unknown' THEN brand END) AS brands,
    CAST(sum(CASE WHEN title <> '' AND price_value >= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS dear FROM latest GROUP BY site),
lists AS (SELECT site, count(DISTINCT c) AS categories FROM (SELECT site, unnest(categories) AS c FROM latest) GROUP BY site),
asked AS (SELECT replace(lower(n_name), '_', '-') AS site FROM nation UNION ALL SELECT 'no-such-store'),
told AS (SELECT asked.site, f.format, coalesce(titled, 0) AS titled, coalesce(CASE f.format WHEN 'json' THEN n WHEN 'categories' THEN categories
    WHEN 'brands' THEN brands WHEN 'dear' THEN dear ELSE titled END, 0) AS rows
  FROM asked LEFT JOIN due USING (site) LEFT JOIN lists USING (site)
  CROSS JOIN (VALUES ('json'), ('csv'), ('excel'), ('xml'), ('categories'), ('brands'), ('dear')) f(format))
SELECT site, format, rows, CASE WHEN format = 'dear' AND rows <> titled THEN concat('wrote ', rows, ' of ', titled, ' rows') ELSE '' END AS error FROM told""")
def export_bundle(spark, sf):
    """Rows of the files themselves. A store without records is asked for too, and a user's format writes dear products only."""
    names = table(spark, sf, "nation").select(F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))).collect()

    def dear(df, path, clean, partition):
        X.export_json(df.where(C.has_title() & (F.col("price_value") >= 1000)), path, clean, partition)

    products = latest(spark, sf, [*EXPORT_FIELDS, "site"])
    done = X.export_bundle(
        products.select("site", *EXPORT_FIELDS), scratch_path(spark, "bundle"), [*(r[0] for r in names), "no-such-store"],
        [*X.FORMATS, "dear"], writers={"dear": dear})
    return done.select("site", "format", "rows", F.coalesce("error", F.lit("")).alias("error"))


@query("append_product_log", "WITH " + LOG_SQL + """
SELECT site, count(*) AS n, count(DISTINCT url) AS urls, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM log GROUP BY site""")
def append_product_log(spark, sf):
    """Two appends, then everything read back."""
    path = scratch_path(spark, "log")
    log = product_log(spark, sf)
    X.append_product_log(log.where("l_linenumber % 2 = 0"), path)
    X.append_product_log(log.where("l_linenumber % 2 = 1"), path)
    back = spark.read.schema("site string, url string, l_linenumber int").json(path)
    urls = back.groupBy("site", "url").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))
    return urls.groupBy("site").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("urls"), F.sum("lines").alias("lines")
    )


def _dirty_lines(spark, sf, by=None):
    """The log as text: with blank, torn, list-valued and scalar lines in between; neighbours by a column on request."""
    log = product_log(spark, sf)
    columns = log.columns
    if by:  # records move, not the text made of them
        log = log.hint("rebalance", by)
    log = log.select("site", "l_orderkey", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))
    good = F.col("line")
    noise = (
        F.when(F.col("l_orderkey") % 4 == 0, F.array(good, F.lit("")))
        .when(F.col("l_orderkey") % 4 == 1, F.array(good, F.substr(good, F.lit(1), F.length(good) - 5)))
        .when(F.col("l_orderkey") % 4 == 2, F.array(F.concat(F.lit("["), good, F.lit("]")), good))
        .otherwise(F.array(F.lit("42"), F.concat(F.lit("  "), good, F.lit(" "))))
    )
    return log.select("site", F.explode(noise).alias("value"))


def _write_lines(lines, path, *partition):
    """Logs are kept compressed; a file is as large as the task that writes it makes it."""
    lines.write.partitionBy(*partition).option("compression", "gzip").text(path)


READ_SQL = LATEST + """
SELECT site, url, title, brand, price_value, array_to_string(categories, '|') AS categories,
  in_stock, l_orderkey AS last_order FROM latest"""


def _read_back(records):
    used = ["site", "title", "brand", "price_value", "categories", "in_stock", "l_orderkey"]
    return C.latest_per_url(records, ORDER, used).select(
        "site", "url", "title", "brand", "price_value",
        F.array_join("categories", "|").alias("categories"), "in_stock", F.col("l_orderkey").alias("last_order"),
    )


@query("read_product_log", READ_SQL)
def read_product_log(spark, sf):
    path = scratch_path(spark, "lines")
    _write_lines(_dirty_lines(spark, sf).select("value"), path)
    return _read_back(L.read_product_log(spark, path, EXTRA))


@query("scan_sites", READ_SQL)
def scan_sites(spark, sf):
    """One log per store folder, written in one job; the store is read off the path."""
    root = scratch_path(spark, "sites")
    lines = _dirty_lines(spark, sf, by="site").withColumn("log", F.lit(L.LOG_NAME))
    _write_lines(lines, root, "site", "log")
    extra = {k: v for k, v in EXTRA.items() if k != "site"}
    return _read_back(L.scan_sites(spark, root, extra))


@query("load_products", READ_SQL)
def load_products(spark, sf):
    """The log is preferred to the (empty) snapshot beside it."""
    folder = scratch_path(spark, "store")
    _write_lines(_dirty_lines(spark, sf).select("value"), f"{folder}/products.jsonl")
    return _read_back(L.load_products(spark, folder, EXTRA))


@query("read_product_snapshot", LATEST + """
SELECT url, title, brand, price_value FROM latest""")
def read_product_snapshot(spark, sf):
    """Indented arrays of records, as a run writes them, and one broken file."""
    path = scratch_path(spark, "snapshot")
    records = latest(spark, sf, [*EXPORT_FIELDS, "l_partkey"])
    _write_snapshots(records, path)
    spark.range(1).select(F.lit('[{"url": "x", ').alias("value")).write.text(f"{path}/chunk=-1")
    return L.read_product_snapshot(spark, f"{path}/*").select(
        "url", "title", "brand", "price_value"
    )


def _write_snapshots(records, path):
    """Each file is one indented array of the records of 500 neighbouring products, whatever the log's size."""
    write_arrays(records, F.struct(*EXPORT_FIELDS), F.floor(F.col("l_partkey") / 500), path)


@query("load_products_of_snapshot", LATEST + " SELECT url, title, brand, price_value FROM latest")
def load_products_of_snapshot(spark, sf):
    """A store that has no log is read from its snapshot."""
    folder = scratch_path(spark, "store")
    _write_snapshots(latest(spark, sf, [*EXPORT_FIELDS, "l_partkey"]), f"{folder}/{L.SNAPSHOT_NAME}")
    return L.load_products(spark, folder).select("url", "title", "brand", "price_value")


@query("load_resume", LATEST + " SELECT url, title, brand, price_value FROM latest")
def load_resume(spark, sf):
    """A run goes on from the snapshot where the log beside it holds no record yet."""
    folder = scratch_path(spark, "store")
    _write_snapshots(latest(spark, sf, [*EXPORT_FIELDS, "l_partkey"]), f"{folder}/{L.SNAPSHOT_NAME}")
    _dirty_lines(spark, sf).select(F.lit("").alias("value")).write.text(f"{folder}/{L.LOG_NAME}")
    return L.load_resume(spark, folder).select("url", "title", "brand", "price_value")


@query("write_snapshot", LATEST + """
SELECT 'products' AS part, count(*) AS n FROM latest
UNION ALL SELECT 'categories', count(DISTINCT c) FROM (SELECT unnest(categories) AS c FROM latest)
UNION ALL SELECT 'failures', count(*) FROM latest WHERE title = ''""")
def write_snapshot(spark, sf):
    root = scratch_path(spark, "published")
    found = scratch_path(spark, "found")  # published twice, and read for the failures
    latest(spark, sf, EXPORT_FIELDS).drop("position").write.parquet(found)
    products = spark.read.parquet(found)
    failed = products.where(~C.has_title()).select("url", F.lit("no product data found in page").alias("reason"))
    X.write_snapshot(products, failed, root, "001")
    X.write_snapshot(products, failed, root, "002")
    parts = None
    for name in ("products", "categories", "failures"):
        counted = X.read_published(spark, f"{root}/{name}").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("part"), "n"
        )
        parts = counted if parts is None else parts.unionByName(counted)
    return parts


@query("normalize_records", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS title,
  CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE p_brand END AS brand,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS categories,
  CAST(round(p_retailprice, 2) AS VARCHAR) AS price, '' AS images, '' AS sku, p_retailprice AS price_value FROM part""")
def normalize_records_query(spark, sf):
    """Old and junk shapes: scalars for lists, numbers for text, missing columns."""
    key = F.col("p_partkey")
    raw = table(spark, sf, "part").select(
        "p_partkey", F.when(key % 4 != 0, F.col("p_name")).alias("title"),
        F.when(key % 3 == 0, F.when(key % 2 == 0, "")).otherwise(F.col("p_brand")).alias("brand"),
        F.when(key % 5 != 0, F.col("p_type")).alias("categories"),
        F.round("p_retailprice", 2).alias("price"), F.col("p_retailprice").alias("price_value"),
    )
    return normalize_records(raw).select(
        "p_partkey", "title", "brand", F.array_join("categories", "|").alias("categories"), "price",
        F.array_join("images", "|").alias("images"), "sku", "price_value",
    )


# ── Folders and files ─────────────────────────────────────────────────────



def _root():
    return F.concat(F.lit("data/"), F.col("site"), F.lit("/structured"))


DIR_SQL = FACTS_SQL + """, placed AS (
  SELECT *, concat('data/', site, '/structured/', categories[1], '/', categories[2], '/',
    CASE WHEN title = '' THEN CAST(p_partkey AS VARCHAR) ELSE replace(title, ' ', '_') END) AS dir FROM facts)"""


@query("product_dir", "WITH " + DIR_SQL + " SELECT url, dir FROM placed")
def product_dir_query(spark, sf):
    where = product_dir(_root(), F.col("categories"), F.col("title"), F.col("url"))
    return product_facts(spark, sf).select("url", where.alias("dir"))


@query("image_path", "WITH " + DIR_SQL + """
SELECT url, concat(dir, '/images/', p_partkey, '-0.jpg') AS path FROM placed""")
def image_path_query(spark, sf):
    where = product_dir(_root(), F.col("categories"), F.col("title"), F.col("url"))
    folder = F.concat(where, F.lit("/images"))
    return product_facts(spark, sf).select("url", image_path(folder, F.get("images", F.lit(0))).alias("path"))


@query("product_documents", "WITH " + DIR_SQL + """
SELECT concat(dir, '/', kind) AS path, kind, CASE kind WHEN 'data.json' THEN url
  ELSE concat(regexp_extract(short_description, '^<p>([^&]*)', 1), '& more', chr(10), categories[1]) END AS content
FROM placed CROSS JOIN (VALUES ('data.json'), ('short_description.txt')) k(kind)""")
def product_documents(spark, sf):
    records = product_facts(spark, sf).select(
        "title", "url", "categories", "images", "short_description", F.lit("").alias("long_description"), "site"
    )
    documents = FI.product_documents(records, _root())
    content = F.when(F.col("kind") == "data.json", F.get_json_object("content", "$.url")).otherwise(F.col("content"))
    return documents.select("path", "kind", content.alias("content"))


def _tree(spark, sf):
    """A file listing: documents and images, some images under other names or in older places."""
    key = F.col("p_partkey")
    facts = product_facts(spark, sf, heavy=True)
    folder = product_dir(_root(), F.col("categories"), F.col("title"), F.col("url"))
    # Older trees placed a fifth of the products elsewhere.
    where = F.when(key % 5 == 0, F.concat_ws("/", _root(), F.lit("Old"), F.concat(F.lit("f"), key.cast("string")))).otherwise(folder)
    image = F.concat(key.cast("string"), F.when(key % 4 == 0, "-0_ab12cd.jpg").otherwise("-0.jpg"))
    empty = F.lit(None).cast("string")
    members = F.array(
        F.struct(F.lit("data.json").alias("name"), F.to_json(F.struct("url")).alias("content")),
        F.struct(F.lit("description.md").alias("name"), empty.alias("content")),
        F.struct(F.concat(F.lit("images/"), image).alias("name"), empty.alias("content")),
    )
    return facts.select("site", "p_partkey", where.alias("dir"), F.explode(members).alias("m")).where(
        ~((key % 11 == 0) & F.col("m.name").startswith("images/"))
    ).select("site", "p_partkey", F.concat_ws("/", "dir", "m.name").alias("path"), "m.content")


TREE_SQL = DIR_SQL + """, folders AS (
  SELECT *, CASE WHEN p_partkey % 5 = 0 THEN concat('data/', site, '/structured/Old/f', p_partkey) ELSE dir END AS folder,
    concat(p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '-0_ab12cd.jpg' ELSE '-0.jpg' END) AS image FROM placed),
tree AS (
  SELECT site, p_partkey, url, folder, concat(folder, '/', k.name) AS path, k.name AS name FROM folders
  CROSS JOIN (VALUES ('data.json'), ('description.md')) k(name)
  UNION ALL SELECT site, p_partkey, url, folder, concat(folder, '/images/', image), 'image' FROM folders WHERE p_partkey % 11 <> 0)"""


@query("product_folder_index", "WITH " + TREE_SQL + """, folders_with_images AS (
  SELECT DISTINCT site, folder FROM tree WHERE name = 'image')
SELECT tree.site, url, min(folder) AS folder FROM tree JOIN folders_with_images USING (site, folder)
WHERE name = 'data.json' GROUP BY tree.site, url""")
def product_folder_index(spark, sf):
    """Products of equal category and title share a folder; an image of any of them counts."""
    return FI.product_folder_index(_tree(spark, sf))


@query("resolve_images", "WITH " + TREE_SQL + """, stored AS (
  SELECT DISTINCT site, path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS dir, regexp_extract(path, '([^/]+)[.]jpg$', 1) AS stem
  FROM tree WHERE name = 'image'),
known AS (SELECT tree.site, url, concat(min(folder), '/images') AS dir FROM tree
  WHERE name = 'data.json' AND (tree.site, concat(folder, '/images')) IN (SELECT (site, dir) FROM stored) GROUP BY tree.site, url),
tries AS (SELECT site, url, p_partkey, 0 AS first, concat(dir, '/images') AS dir FROM placed
  UNION ALL SELECT placed.site, url, p_partkey, 3, known.dir FROM placed JOIN known USING (site, url)),
hits AS (SELECT tries.site, url, min(concat(CASE WHEN stem = concat(p_partkey, '-0') THEN first ELSE first + 2 END, path)) AS best
  FROM tries JOIN stored ON stored.site = tries.site AND stored.dir = tries.dir
    AND (starts_with(stem, concat(p_partkey, '-0')) OR starts_with(concat(p_partkey, '-0'), stem)) GROUP BY tries.site, url)
SELECT site, url, images[1] AS src, coalesce(substr(best, 2), '') AS path,
  CASE WHEN best IS NULL THEN 'missing' WHEN best[1] IN ('2', '5') THEN 'near' ELSE 'exact' END AS how
FROM placed LEFT JOIN hits USING (site, url)""")
def resolve_images(spark, sf):
    """Wanted images against all stored ones; names within a folder are compared whole."""
    tree = stored(_tree(spark, sf), "tree")
    wanted = product_facts(spark, sf, heavy=True).select(
        "site", "url", "title", "categories", F.get("images", F.lit(0)).alias("src")
    )
    return FI.resolve_images(wanted, tree.select("site", "path").distinct(), FI.product_folder_index(tree), _root())


MEMBER = """SELECT path, concat('{label}/', path) AS member, lower(path) LIKE '%.jpg' AS stored FROM tree WHERE {where}"""


@query("archive_manifest", "WITH " + TREE_SQL + " " + " UNION ALL ".join([
    MEMBER.format(label="everything", where="true"),
    MEMBER.format(label="data-only", where="name <> 'image'"),
    "SELECT path, concat(regexp_extract(path, '([^/]+)/images/', 1), '/', regexp_extract(path, '([^/]+)$', 1)) AS member, "
    "lower(path) LIKE '%.jpg' AS stored FROM tree WHERE name = 'image'"]))
def archive_manifest(spark, sf):
    tree = _tree(spark, sf).select("site", "path")
    parts = [FI.archive_manifest(tree, "archive_all"), FI.archive_manifest(tree, "archive_data"),
             FI.archive_manifest(tree, "archive_images", flatten=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("path", "member", "stored")


@query("file_kind", "WITH " + TREE_SQL + """
SELECT CASE WHEN name = 'image' THEN 'image' WHEN name = 'data.json' THEN 'json' ELSE 'markdown' END AS kind,
  count(*) AS n FROM tree GROUP BY 1""")
def file_kind(spark, sf):
    return _tree(spark, sf).groupBy(FI.file_kind(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _folders(spark, sf):
    """Store folders: one per supplier-like name, with kept versions 2, 3 and 5 for some."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("store-"), key.cast("string"), F.lit(".example"))
    kept = F.when(key % 3 == 0, F.array(F.lit(2), F.lit(3), F.lit(5))).when(key % 3 == 1, F.array(F.lit(3)))
    versions = F.transform(
        F.coalesce(kept, F.array().cast("array<int>")),
        lambda v: F.concat(name, F.lit("_v"), v.cast("string"), F.lit("_20240101-000000")),
    )
    return table(spark, sf, "supplier").select(F.explode(F.concat(F.array(name), versions)).alias("name"))


@query("next_site_version", """
SELECT concat('store-', s_suppkey, '.example') AS site, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 2 END AS version FROM supplier""")
def next_site_version(spark, sf):
    return FI.next_site_version(_folders(spark, sf))


@query("validate_store_url", """
SELECT concat(CASE WHEN s_suppkey % 2 = 0 THEN 'https://www.' ELSE '' END, 'Store-', s_suppkey,
    CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '.example' END, '/x') AS url,
  s_suppkey % 5 <> 0 AS valid, CASE WHEN s_suppkey % 5 <> 0 THEN concat('store-', s_suppkey, '.example') END AS site,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 7 ELSE 0 END AS products,
  CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_suppkey % 3 = 0 THEN 3 WHEN s_suppkey % 3 = 1 THEN 1 ELSE 0 END AS versions FROM supplier""")
def validate_store_url(spark, sf):
    key = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier")
    asked = suppliers.select(F.concat(
        F.when(key % 2 == 0, "https://www.").otherwise(""), F.lit("Store-"), key.cast("string"),
        F.when(key % 5 == 0, "").otherwise(".example"), F.lit("/x"),
    ).alias("url"))
    summary = suppliers.select(
        F.concat(F.lit("store-"), key.cast("string"), F.lit(".example")).alias("site"), (key % 7).alias("products")
    )
    return FI.validate_store_url(asked, summary, _folders(spark, sf))


@query("trimmed_list_values", "WITH " + FACTS_SQL + " SELECT DISTINCT brand AS value FROM facts")
def trimmed_list_values(spark, sf):
    padded = product_facts(spark, sf).select(F.concat(F.lit("  "), "brand", F.lit("\t")).alias("brand"))
    return C.distinct_list(padded, "brand", drop_unknown=False)
