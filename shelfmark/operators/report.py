"""One row per store: reachability, platform, sitemaps, APIs, and how products would be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.text import strip
from shelfmark.operators.discovery import (
    detect_platform, is_product_sitemap, is_sitemap_index, robots_sitemaps, sitemap_locations,
    wordpress_facts,
)

# Labels of the API probes by endpoint.
API_NAMES = {
    "woo": "WooCommerce Store API", "wp": "WordPress REST API",
    "shopify": "Shopify products.json", "opencart": "OpenCart search route",
}


def _api(endpoint, answered, products):
    return F.when(
        answered,
        F.struct(
            F.lit(API_NAMES[endpoint]).alias("name"), F.lit(True).alias("available"), products.alias("products")
        ),
    )


def site_report(homepages: DataFrame, robots: DataFrame, sitemaps: DataFrame, probes: DataFrame) -> DataFrame:
    """Report per site, all equi-joins on the site or on a sitemap's address.

    ``homepages(site, base, html, reason, profile)``, ``robots(site, body)``,
    ``sitemaps(sitemap_url, xml)``, ``probes(site, endpoint, status, headers, body)``.
    """
    none = F.array().cast("array<string>")
    home = homepages.select(
        "site", "base", "reason", "profile",
        (F.coalesce("html", F.lit("")) != "").alias("reachable"),
        detect_platform(F.col("html")).alias("platform"), wordpress_facts(F.col("html")).alias("wordpress"),
    )
    bodies = robots.groupBy("site").agg(F.min(F.nullif(F.col("body"), F.lit(""))).alias("robots"))
    asked = (
        home.join(bodies, "site", "left")
        .withColumn("robots_txt", F.col("reachable") & (F.coalesce("robots", F.lit("")) != ""))
        .withColumn(
            "sitemaps",
            F.when(F.col("robots_txt"), robots_sitemaps(F.col("robots"))).otherwise(none),
        )
        .withColumn(
            "index_url",
            F.coalesce(F.get("sitemaps", F.lit(0)), F.concat("base", F.lit("/sitemap_index.xml"))),
        )
    )
    # The children of an index are an array of its own document, never a group of rows.
    documents = sitemaps.select(
        F.col("sitemap_url").alias("index_url"), is_sitemap_index(F.col("xml")).alias("is_index"),
        F.filter(sitemap_locations(F.col("xml")), is_product_sitemap).alias("product_children"),
        F.size(sitemap_locations(F.col("xml"))).alias("n_children"),
    )
    body = F.when(strip(F.col("body")).startswith("{"), F.col("body"))
    listed = F.from_json(body, "products array<variant>")["products"]
    answers = probes.groupBy("site").agg(
        *[F.bool_or((F.col("endpoint") == e) & (F.col("status") == 200)).alias(f"{e}_ok") for e in API_NAMES],
        F.max(F.when(F.col("endpoint") == "woo", F.col("headers")["X-WP-Total"].try_cast("long"))).alias("woo_total"),
        F.max(F.when(F.col("endpoint") == "shopify", F.when(listed.isNotNull(), F.size(listed)))).alias("shopify_n"),
    )
    joined = asked.join(documents, "index_url", "left").join(answers, "site", "left")

    pid, supported = F.col("platform.id"), F.col("platform.supported")
    reachable = F.col("reachable")
    is_wp = pid.isin("woocommerce", "wordpress")
    asks_shopify = (pid == "shopify") | ~supported
    number = F.lit(None).cast("long")
    small = F.when(F.col("shopify_n") < 250, F.col("shopify_n").cast("long"))
    apis = F.filter(
        F.array(
            _api("woo", is_wp & F.col("woo_ok"), F.col("woo_total")),
            _api("wp", is_wp & F.col("wp_ok"), number),
            _api("shopify", asks_shopify & F.col("shopify_n").isNotNull(), small),
            _api("opencart", (pid == "opencart") & F.col("opencart_ok"), number),
        ),
        lambda a: a.isNotNull() & reachable,
    )
    product_sitemaps = (
        F.when(~reachable | F.col("is_index").isNull(), none)
        .when(F.col("is_index"), F.col("product_children"))
        .when(F.col("n_children") > 0, F.array("index_url"))
        .otherwise(none)
    )
    listed_sitemaps = F.when(
        reachable & F.col("is_index") & ~F.array_contains("sitemaps", F.col("index_url")),
        F.concat("sitemaps", F.array("index_url")),
    ).otherwise(F.when(reachable, F.col("sitemaps")).otherwise(none))
    read = joined.select(
        "site", "base", "reachable", "reason", "profile", "platform", "wordpress", "robots_txt",
        listed_sitemaps.alias("sitemaps"), product_sitemaps.alias("product_sitemaps"), apis.alias("apis"),
        F.when(reachable & asks_shopify & small.isNotNull(), small)
        .when(reachable & is_wp & F.col("woo_ok"), F.col("woo_total")).alias("estimated_products"),
        (is_wp & F.col("woo_ok") & F.col("woo_total").isNotNull()).alias("_woo"),
        (asks_shopify & F.col("shopify_n").isNotNull()).alias("_shopify"),
        ((pid == "opencart") & F.col("opencart_ok")).alias("_opencart"),
    )
    nothing = (F.size("product_sitemaps") == 0) & (F.size("apis") == 0)
    strategy = (
        F.when(~reachable, F.lit(None).cast("string"))
        .when(nothing, "listing_crawl")
        .when(F.size("product_sitemaps") > 0, "sitemap")
        .when(F.col("_woo"), "woocommerce_api")
        .when(F.col("_shopify"), "shopify_api")
        .when(F.col("_opencart"), "opencart_routes")
    )
    reason = F.coalesce("reason", F.lit("unreachable"))
    walled = F.lower(reason).contains("challenge") | reason.contains("HTTP 403")
    warning = (
        F.when(~reachable & walled, "The store answers with an interactive challenge page.")
        .when(~reachable, F.concat(F.lit("The homepage could not be fetched ("), reason, F.lit(").")))
        .when(nothing, "No product sitemap or API; products would come from a listing crawl.")
    )
    note = (
        F.when(~reachable, F.lit(None).cast("string"))
        .when(supported, F.concat("platform.name", F.lit(" is fully supported.")))
        .when(pid == "wordpress", "WordPress without a store plugin.")
        .when(pid != "unknown", F.concat("platform.name", F.lit(" has no discovery strategy of its own.")))
        .otherwise("Unidentified platform.")
    )
    fingerprint = F.when(
        reachable & (F.coalesce("profile", F.lit("chrome")) != "chrome"),
        F.concat(F.lit("The default profile is rejected; profile in use: "), "profile"),
    )
    unknown = F.struct(
        F.lit("unknown").alias("id"), F.lit("Unknown").alias("name"), F.lit(False).alias("supported"),
        F.lit("none").alias("confidence"), none.alias("evidence"),
    )
    return read.select(
        "site", F.col("base").alias("url"), "reachable",
        F.when(~reachable, reason).alias("reason"),
        F.when(reachable, F.col("platform")).otherwise(unknown).alias("platform"),
        "wordpress", "robots_txt", "sitemaps", "product_sitemaps", "apis", "estimated_products",
        strategy.alias("strategy"), F.when(reachable, F.col("profile")).alias("fingerprint"),
        F.array_compact(F.array(warning)).alias("warnings"),
        F.array_compact(F.array(fingerprint, note)).alias("notes"),
    )
