"""The catalogue: latest record per URL, search, paging, statistics, distinct lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import strip
from shelfmark.runtime import with_global_index
from shelfmark.schema import UNKNOWN_BRAND


def has_title() -> Column:
    return F.coalesce(F.col("title"), F.lit("")) != ""


def is_complete() -> Column:
    """Records that count as scraped; the others are fetched again."""
    return (F.coalesce(F.col("url"), F.lit("")) != "") & has_title()


def latest_per_url(log: DataFrame, order: list, columns: list | None = None) -> DataFrame:
    """Last record per URL in ``order``, at the place of its first sighting.

    Records without a URL are all kept. ``order`` must be unique per record. One aggregation
    with map-side combine, so a URL that fills a third of the log costs no more than another.
    The ``position`` column sorts as the reference's batch read lists: records without URL last.
    """
    payload = [c for c in (columns or log.columns) if c != "url"]
    no_url = F.coalesce(F.col("url"), F.lit("")) == ""
    place = F.struct(*order)
    keyed = log.select(
        "url",
        F.when(no_url, place).alias("_own"),
        F.struct(*payload).alias("_record"),
        place.alias("_place"),
    )
    latest = keyed.groupBy("url", "_own").agg(
        F.max_by("_record", "_place").alias("_record"), F.min("_place").alias("_first")
    )
    return latest.select(
        "url", *[F.col(f"_record.{c}").alias(c) for c in payload],
        F.struct(F.col("_own").isNotNull().alias("no_url"), F.col("_first").alias("first")).alias("position"),
    )


def search_products(df: DataFrame, search: str = "", category: str = "") -> DataFrame:
    """Titled records with ``search`` in title or short description, in ``category``."""
    out = df.where(has_title())
    if search:
        wanted = search.lower()
        texts = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "short_description")]
        out = out.where(texts[0].contains(wanted) | texts[1].contains(wanted))
    if category:
        out = out.where(F.coalesce(F.array_contains("categories", category), F.lit(False)))
    return out


def _ranked(df: DataFrame, order: list, keep: Column, newest_first: bool = False) -> DataFrame:
    """Rows whose 0-based rank ``_index`` satisfies ``keep``. Only the order's columns are ranked; the
    ranks that are kept cut the table by a semi-join's cost, and meet the other columns only there.
    ``order`` is unique, so a key is one row."""
    names = [f"_k{i}" for i in range(len(order))]
    value = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = df.select(*[v.alias(n) for v, n in zip(value, names)])
    kept = with_global_index(keys, [F.col(n).desc() for n in names] if newest_first else names, "_index").where(keep)
    same = F.lit(True)
    for v, n in zip(value, names):
        same = same & v.eqNullSafe(F.col(n))
    return df.join(kept, same).drop(*names)


def paginate(df: DataFrame, page: int, limit: int, order: list) -> DataFrame:
    """One page of the catalogue in order, by the global index of the order's columns."""
    start = (page - 1) * limit
    return _ranked(df, order, F.col("_index").between(start, start + limit - 1)).orderBy("_index").drop("_index")


def page_info(df: DataFrame, page: int, limit: int) -> DataFrame:
    total = F.count(F.lit(1))
    pages = F.ceil(F.col("total") / limit)
    return df.agg(total.alias("total")).select(
        "total", F.lit(page).alias("page"), pages.alias("total_pages"), (F.lit(page) < pages).alias("has_more")
    )


def limit_urls(df: DataFrame, n: int | None, order: list) -> DataFrame:
    """The first ``n`` rows; all of them for 0 or None."""
    if not n:
        return df
    return _ranked(df, order, F.col("_index") < n).orderBy("_index").drop("_index")


def log_tail(df: DataFrame, n: int, order: list) -> DataFrame:
    """The last ``n`` rows, oldest first."""
    return _ranked(df, order, F.col("_index") < n, newest_first=True).orderBy(F.desc("_index")).drop("_index")


def catalogue_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Products (all), distinct categories and brands, and images (titled records).

    One scan: every record becomes its category and brand values and one counting row; values
    are made distinct with map-side combine before they are counted.
    """
    titled = has_title()
    none = F.array().cast("array<string>")
    brand = F.when(F.coalesce(F.col("brand"), F.lit("")).isin("", UNKNOWN_BRAND), none).otherwise(
        F.array("brand")
    )
    if approximate:
        flat = df.select(
            F.when(titled, F.coalesce(F.col("categories"), none)).otherwise(none).alias("c"),
            F.get(F.when(titled, brand), F.lit(0)).alias("b"),
            F.when(titled, F.coalesce(F.size("images"), F.lit(0))).otherwise(0).alias("i"),
        ).select("b", F.posexplode_outer("c").alias("at", "c"), "i")
        first = F.coalesce(F.col("at"), F.lit(0)) == 0
        return flat.agg(
            F.sum(first.cast("long")).alias("total_products"),
            F.approx_count_distinct("c").alias("total_categories"),
            F.approx_count_distinct("b").alias("total_brands"),
            F.sum(F.when(first, F.col("i")).otherwise(0)).cast("long").alias("total_images"),
        )

    def rows(kind, values):
        return F.transform(
            F.when(titled, F.coalesce(values, none)).otherwise(none),
            lambda v: F.struct(
                F.lit(kind).alias("kind"), v.alias("value"), F.lit(0).alias("products"), F.lit(0).alias("images")
            ),
        )

    images = F.when(titled & F.col("images").isNotNull(), F.size("images")).otherwise(0)
    counting = F.array(
        F.struct(
            F.lit("t").alias("kind"), F.lit("").alias("value"), F.lit(1).alias("products"), images.alias("images")
        )
    )
    facts = df.select(F.explode(F.concat(rows("c", F.col("categories")), rows("b", brand), counting)).alias("f"))
    values = facts.groupBy("f.kind", "f.value").agg(
        F.sum("f.products").alias("products"), F.sum("f.images").alias("images")
    )
    return values.agg(
        F.coalesce(F.sum("products"), F.lit(0)).alias("total_products"),
        F.count_if(F.col("kind") == "c").alias("total_categories"),
        F.count_if(F.col("kind") == "b").alias("total_brands"),
        F.coalesce(F.sum("images"), F.lit(0)).alias("total_images"),
    )


def site_summary(sites: DataFrame, products: DataFrame, failed: DataFrame, active: str | None = None) -> DataFrame:
    """Per site of ``sites(site, modified)``, one row each: products, failures, time of change, active or not.

    One aggregation over all three inputs, with map-side combine. Without an ``active`` name the newest site is the active one.
    """
    modified = F.lit(None).cast(sites.schema["modified"].dataType)

    def facts(rows, listed, product, failure, at):
        return rows.select("site", F.lit(listed).alias("listed"), F.lit(product).alias("product"), F.lit(failure).alias("failure"), at.alias("modified"))

    rows = facts(sites, 1, 0, 0, F.col("modified")).unionByName(facts(products, 0, 1, 0, modified)).unionByName(facts(failed, 0, 0, 1, modified))
    joined = rows.groupBy("site").agg(
        F.sum("listed").alias("_listed"), F.sum("product").alias("products"), F.sum("failure").alias("failed"), F.max("modified").alias("modified"),
    ).where("_listed > 0")
    if active is None:
        newest = sites.orderBy(F.col("modified").desc(), "site").limit(1).select(
            "site", F.lit(True).alias("_active")
        )
        joined = joined.join(newest, "site", "left")
    else:
        joined = joined.withColumn("_active", F.col("site") == active)
    return joined.select(
        "site", F.coalesce("products", F.lit(0)).alias("products"),
        F.coalesce("failed", F.lit(0)).alias("failed"), "modified",
        F.coalesce("_active", F.lit(False)).alias("active"),
    )


def newest_sites(sites: DataFrame) -> DataFrame:
    return sites.orderBy(F.col("modified").desc(), "site")


def distinct_values(df: DataFrame, field: str, by: tuple = ()) -> DataFrame:
    """Distinct values of a scalar or list field as ``value``, within the columns ``by``."""
    is_list = dict(df.dtypes)[field].startswith("array")
    value = F.explode(field) if is_list else F.col(field)
    return df.select(*by, value.alias("value")).where("value is not null").distinct()


def distinct_list(df: DataFrame, field: str, drop_unknown: bool = True, drop_blank: bool = True, by: tuple = ()) -> DataFrame:
    """Trimmed distinct values of a field as ``value``, unordered, within the columns ``by``."""
    values = distinct_values(df, field, by).where(F.col("value") != "")
    if drop_unknown:
        values = values.where(F.col("value") != UNKNOWN_BRAND)
    trimmed = values.select(*by, strip(F.col("value")).alias("value"))
    if drop_blank:
        trimmed = trimmed.where(F.col("value") != "")
    return trimmed.distinct()


def pending_urls(discovered: DataFrame, done: DataFrame) -> DataFrame:
    """Discovered URLs that are not done; duplicates are kept."""
    return discovered.join(done.select("url"), "url", "left_anti")


def lookup_product(df: DataFrame, refs: DataFrame, order: Column | str) -> DataFrame:
    """First product with the exact URL of a reference, else the first with its exact title.

    ``refs(ref_url, ref_title)``. The different keys that are asked for cut the catalogue first, so
    records of other keys are never grouped; each key is one record before references join it.
    """
    payload = F.struct(*[F.col(c) for c in df.columns])

    def firsts(key, name):
        asked = refs.select(F.col(f"ref_{key}").alias(key)).where(F.coalesce(F.col(key), F.lit("")) != "").distinct()
        return (
            df.join(asked, key, "left_semi")
            .groupBy(F.col(key).alias(f"ref_{key}"))
            .agg(F.min_by(payload, order).alias(name))
        )

    found = refs.join(firsts("url", "_by_url"), "ref_url", "left").join(
        firsts("title", "_by_title"), "ref_title", "left"
    )
    return found.select(
        "ref_url", "ref_title", F.coalesce("_by_url", "_by_title").alias("product")
    ).select("ref_url", "ref_title", "product.*")


def run_progress(attempts: DataFrame, total: Column) -> DataFrame:
    """``(current, total, eta)`` of ``attempts(ts)``: one finished URL per row."""
    seconds = F.col("ts").cast("timestamp").cast("double")
    seen = attempts.agg(
        F.count(F.lit(1)).alias("current"), total.alias("total"),
        F.min(seconds).alias("started"), F.max(seconds).alias("now"),
    )
    elapsed = F.col("now") - F.col("started")
    eta = F.when(
        F.col("current") > 0, F.round((F.col("total") - F.col("current")) * elapsed / F.col("current"), 2)
    ).otherwise(F.lit(0.0))
    return seen.select("current", "total", eta.alias("eta"))
