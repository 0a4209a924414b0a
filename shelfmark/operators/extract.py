"""A product record out of a page, layer by layer, all on the page's own row.

Order of the layers differs by field; each field takes the first layer with a value, and
``extracted_by`` tells which one that was. No step moves data between tasks: there are two Arrow
stages (elements, entities) and native expressions around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.base import first_of, let
from shelfmark.functions.money import currency_in, format_price, to_number
from shelfmark.functions.text import alnum_key, clean_text, html_escape, strip, unescape_all
from shelfmark.functions.urls import host_of
from shelfmark.operators import jsonld
from shelfmark.operators.elements import (
    ERROR_TAG, css_hit, element_array, matched, meta_value, microdata_values, of_tag, rule_numbers,
    selector_name, words,
)
from shelfmark.operators.images import dedupe_image_variants, extract_images
from shelfmark.operators.rules import BREADCRUMB_FILLER, CATEGORY_NOISE, SELECTORS
from shelfmark.runtime import built_once
from shelfmark.schema import UNKNOWN_BRAND

# The single strings of a page that may hold entities, in the order they are decoded.
_CSS_FIELDS = ["title", "price", "brand", "sku", "short_description", "long_description"]
_MICRODATA = ["name", "price", "priceCurrency", "availability", "sku", "image"]
_TEXTS = ["name", "brand", "manufacturer", "sku", "mpn", "description", "currency", "availability"]


def breadcrumbs_from_markup(elements: Column, selectors: dict = SELECTORS) -> Column:
    """``struct(source, names)`` of the first breadcrumb container with link texts."""
    anchors = of_tag(elements, "a")

    def trail(rule):
        return let(
            first_of(matched(elements, rule)),
            lambda box: F.transform(
                F.filter(anchors, lambda a: (a["pos"] > box["pos"]) & (a["pos"] < box["stop"])),
                lambda a: clean_text(words(a)),
            ),
        )

    trails = F.transform(
        rule_numbers("breadcrumbs", selectors),
        lambda r: F.struct(
            selector_name("breadcrumbs", r, selectors).alias("source"),
            F.filter(trail(r), lambda n: n != "").alias("names"),
        ),
    )
    return first_of(F.filter(trails, lambda t: F.size(t["names"]) > 0))


def clean_breadcrumbs(names: Column, title: Column) -> Column:
    """Category names of a trail: filler, the product itself and repeats dropped.

    ``names`` and ``title`` have their entities decoded.
    """
    keyed = F.transform(
        F.coalesce(names, F.array().cast("array<string>")),
        lambda n: let(
            clean_text(n),
            lambda name: F.struct(
                name.alias("name"),
                F.regexp_replace(F.lower(name), "^[ .]+|[ .]+$", "").alias("low"),
                alnum_key(name).alias("key"),
            ),
        ),
    )

    def without_product(title_key):
        def itself(e):
            either = F.contains(title_key, e["key"]) | F.contains(e["key"], title_key)
            return (title_key != "") & (e["key"] != "") & (
                (e["key"] == title_key) | ((F.length(e["key"]) > 20) & either)
            )

        return F.filter(
            keyed, lambda e: (e["low"] != "") & ~e["low"].isin(BREADCRUMB_FILLER) & ~itself(e)
        )

    def first_of_each(kept):
        keys = F.transform(kept, lambda e: e["key"])
        unique = F.filter(kept, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
        return F.transform(unique, lambda e: e["name"])

    return let(let(alnum_key(title), without_product), first_of_each)


def brand_from_context(title: Column, categories: Column) -> Column:
    """``struct(brand, source)`` from the last category or the first word of the title."""
    category = F.coalesce(F.try_element_at(categories, F.lit(-1)), F.lit(""))
    bare = F.regexp_replace(category, "(?iU)" + CATEGORY_NOISE, "")
    bare = F.regexp_replace(bare, r"^[ \-–|,]+|[ \-–|,]+$", "")
    changed = (bare != "") & (alnum_key(bare) != alnum_key(category))
    word = F.regexp_extract(title, r"(?U)^\s*(\S+)", 1)
    return (
        F.when(changed, F.struct(bare.alias("brand"), F.lit("category-heuristic").alias("source")))
        .when(word.rlike(r"^\p{L}"), F.struct(word.alias("brand"), F.lit("title-first-word").alias("source")))
        .otherwise(F.struct(F.lit("").alias("brand"), F.lit(None).cast("string").alias("source")))
    )


def store_key(url: Column) -> Column:
    """The store's own name as a comparison key, out of its host."""
    return alnum_key(F.regexp_replace(host_of(url), r"^www\.|\.[a-z.]+$", ""))


def stock_state(availability: Column) -> Column:
    """True, false or unknown, from an availability word."""
    low = F.lower(F.coalesce(availability, F.lit("")))
    return F.when(low.rlike("instock|in_stock|limited"), True).when(low.rlike("outofstock|soldout"), False)


def _first(*layers) -> Column:
    """``struct(value, source)`` of the first layer with text."""
    options = F.array(
        *[F.struct(value.alias("value"), source.alias("source")) for value, source in layers]
    )
    return F.coalesce(
        first_of(F.filter(options, lambda o: o["value"] != "")),
        F.struct(F.lit("").alias("value"), F.lit(None).cast("string").alias("source")),
    )


def _text(hit: Column) -> Column:
    return F.coalesce(clean_text(hit["text"]), F.lit(""))


def page_facts(pages: DataFrame, selectors: dict = SELECTORS) -> DataFrame:
    """Elements, structured data and rule hits per page: what every field is read from."""
    carried = [c for c in pages.columns if c != "html"]

    def once(step, build):
        return built_once((step, repr(selectors)), build)

    el, product, texts = F.col("el"), F.col("product"), F.col("texts")
    kept = ["el", "metas", "micro", *[f"css_{f}" for f in _CSS_FIELDS]]
    empty = F.array().cast("array<string>")
    markup = F.coalesce(F.col("markup.names"), empty)
    n = len(_TEXTS) + 1

    def reading():
        return [
            element_array(F.col("html"), selectors).alias("el"),
            jsonld.jsonld_nodes(jsonld.jsonld_payloads(F.col("html"))).alias("nodes"),
        ]

    def choosing():
        return [
            jsonld.best_product_node(F.col("nodes")).alias("product"),
            jsonld.jsonld_breadcrumbs(F.col("nodes")).alias("crumbs"),
            of_tag(el, "meta").alias("metas"),
            microdata_values(el, *_MICRODATA).alias("micro"),
            *[css_hit(el, f, selectors).alias(f"css_{f}") for f in _CSS_FIELDS],
            breadcrumbs_from_markup(el, selectors).alias("markup"),
        ]

    def structured():
        images = F.transform(
            jsonld.as_list(F.try_variant_get(product, "$.image", "variant")),
            lambda v: jsonld.first_str(v),
        )
        return [
            jsonld.offers_summary(product).alias("offers"),
            jsonld.node_texts(product, *_TEXTS[:6]).alias("ld"),
            F.coalesce(F.filter(images, lambda u: u != ""), empty).alias("ld_images"),
        ]

    def decoding():
        # One trip to Python decodes the entities of every string of the page.
        singles = F.array(
            *[F.coalesce(F.col("ld")[k], F.lit("")) for k in _TEXTS[:6]],
            F.coalesce(F.col("offers.currency"), F.lit("")),
            F.coalesce(F.col("offers.availability"), F.lit("")),
            _text(F.col("css_title")),
        )
        return [
            F.size("crumbs").alias("n_crumbs"), F.size(markup).alias("n_markup"),
            unescape_all(F.concat(singles, F.col("crumbs"), markup, F.col("ld_images"))).alias("texts"),
        ]

    def unpacking():
        after_crumbs = F.lit(n + 1) + F.col("n_crumbs")
        images = F.slice(
            texts, after_crumbs + F.col("n_markup"), F.greatest(F.size(texts), F.lit(1))
        )
        return [
            F.col("markup.source").alias("markup_source"),
            F.col("offers.price_value").alias("ld_price"),
            *[strip(F.get(texts, F.lit(i))).alias(f"ld_{k}") for i, k in enumerate(_TEXTS)],
            F.get(texts, F.lit(n - 1)).alias("css_title_key"),
            F.slice(texts, F.lit(n + 1), F.col("n_crumbs")).alias("crumbs"),
            F.slice(texts, after_crumbs, F.col("n_markup")).alias("markup_names"),
            F.transform(images, strip).alias("ld_images"),
        ]

    read = pages.where(F.coalesce(F.col("html"), F.lit("")) != "").select(
        *carried, *once("reading", reading)
    )
    chosen = read.select(*carried, "el", *once("choosing", choosing))
    found = chosen.select(*carried, *kept, "crumbs", "markup", *once("structured", structured))
    packed = found.select(*carried, *kept, "markup", "offers", *once("decoding", decoding))
    return packed.select(*carried, *kept, *once("unpacking", unpacking))


def extract_title(facts: DataFrame) -> DataFrame:
    """Theme title, structured name, meta title, microdata, first heading, document title."""
    el = F.col("el")
    heading = clean_text(words(first_of(of_tag(el, "h1"))))
    document = clean_text(words(first_of(of_tag(el, "title"))))
    document = F.element_at(F.split(document, r"(?U)\s+[|–—\-]\s+"), 1)
    chosen = _first(
        (_text(F.col("css_title")), F.col("css_title.source")),
        (F.col("ld_name"), F.lit("jsonld")),
        (meta_value(F.col("metas"), "og:title", "twitter:title"), F.lit("opengraph")),
        (F.col("micro")["name"], F.lit("microdata")),
        (F.coalesce(heading, F.lit("")), F.lit("h1")),
        (F.coalesce(document, F.lit("")), F.lit("document-title")),
    )
    return facts.withColumn("_title", chosen).select(
        "*", clean_text(F.col("_title.value")).alias("title"), F.col("_title.source").alias("by_title")
    ).drop("_title")


def extract_price(facts: DataFrame) -> DataFrame:
    """Offers, meta price, theme price text, microdata. A currency found early is kept."""
    ld = F.col("ld_price")
    text = F.element_at(F.split(_text(F.col("css_price")), r"[–—]|\.\.\."), 1)
    read = facts.select(
        "*",
        to_number(meta_value(F.col("metas"), "product:price:amount", "og:price:amount")).alias("_og"),
        meta_value(F.col("metas"), "product:price:currency", "og:price:currency").alias("_og_code"),
        text.alias("_text"), to_number(text).alias("_css"), currency_in(text).alias("_css_code"),
        to_number(F.col("micro")["price"]).alias("_micro"),
        F.col("micro")["priceCurrency"].alias("_micro_code"),
        F.upper("ld_currency").alias("_code"),
    )
    has_text = F.coalesce(F.col("_text"), F.lit("")) != ""

    def codes(*names):
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))

    og_code, css_code = codes("_code", "_og_code"), codes("_code", "_og_code", "_css_code")
    micro_code = codes("_code", "_og_code", "_css_code", "_micro_code")

    def outcome(value, code, display, source):
        return F.struct(
            value.alias("value"), code.alias("code"), display.alias("display"), source.alias("source")
        )

    none = F.lit(None).cast("double")
    shown = clean_text(F.col("_text"))
    price = (
        F.when(ld.isNotNull(), outcome(ld, F.col("_code"), format_price(ld, F.col("_code")), F.lit("jsonld")))
        .when(
            F.col("_og").isNotNull(),
            outcome(F.col("_og"), og_code, format_price(F.col("_og"), og_code), F.lit("opengraph")),
        )
        .when(F.col("_css").isNotNull(), outcome(F.col("_css"), css_code, shown, F.col("css_price.source")))
        .when(
            F.col("_micro").isNotNull(),
            outcome(
                F.col("_micro"), micro_code, format_price(F.col("_micro"), micro_code), F.lit("microdata")
            ),
        )
        .when(F.col("css_price").isNotNull(), outcome(none, css_code, shown, F.col("css_price.source")))
        .otherwise(outcome(none, og_code, F.lit(""), F.lit(None).cast("string")))
    )
    return (
        read.withColumn("_price", price)
        .select(
            "*",
            F.col("_price.display").alias("price"),
            F.col("_price.value").alias("price_value"),
            F.upper("_price.code").alias("currency"),
            F.col("_price.source").alias("by_price"),
        )
        .drop("_price", "_og", "_og_code", "_text", "_css", "_css_code", "_micro", "_micro_code", "_code")
    )


def extract_availability(facts: DataFrame) -> DataFrame:
    micro = F.element_at(F.split(F.col("micro")["availability"], "[/#]"), -1)
    known = F.coalesce(F.nullif(F.col("ld_availability"), F.lit("")), micro)
    return facts.withColumn("availability", known).withColumn("in_stock", stock_state(F.col("availability")))


def extract_categories(facts: DataFrame) -> DataFrame:
    """The structured trail once cleaned, else the cleaned trail of the markup."""
    title = F.when(_text(F.col("css_title")) != "", F.col("css_title_key")).otherwise(F.col("title"))
    trails = facts.select(
        "*",
        clean_breadcrumbs(F.col("crumbs"), title).alias("_ld"),
        clean_breadcrumbs(F.col("markup_names"), title).alias("_css"),
    )
    return trails.select(
        "*",
        F.when(F.size("_ld") > 0, F.col("_ld")).otherwise(F.col("_css")).alias("categories"),
        F.when(F.size("_ld") > 0, F.lit("jsonld"))
        .when(F.size("_css") > 0, F.col("markup_source"))
        .alias("by_categories"),
    ).drop("_ld", "_css")


def extract_brand(facts: DataFrame) -> DataFrame:
    """Structured brand unless it is the store's own name, meta, theme, then context."""
    stated = F.coalesce(F.nullif(F.col("ld_brand"), F.lit("")), F.col("ld_manufacturer"))
    own = store_key(F.col("url"))
    structured = F.when((own != "") & (alnum_key(stated) == own), F.lit("")).otherwise(stated)
    theme = _text(F.col("css_brand"))
    theme = F.when(F.length(theme) < 40, theme).otherwise(F.lit(""))
    read = facts.withColumn("_context", brand_from_context(F.col("title"), F.col("categories")))
    chosen = _first(
        (F.coalesce(structured, F.lit("")), F.lit("jsonld")),
        (meta_value(F.col("metas"), "product:brand", "og:brand"), F.lit("opengraph")),
        (theme, F.col("css_brand.source")),
        (F.col("_context.brand"), F.col("_context.source")),
    )
    return read.withColumn("_brand", chosen).select(
        "*",
        F.coalesce(F.nullif(clean_text(F.col("_brand.value")), F.lit("")), F.lit(UNKNOWN_BRAND)).alias("brand"),
        F.col("_brand.source").alias("by_brand"),
    ).drop("_brand", "_context")


def extract_sku(facts: DataFrame) -> DataFrame:
    options = [
        F.nullif(F.col("ld_sku"), F.lit("")), F.nullif(F.col("ld_mpn"), F.lit("")),
        F.nullif(F.col("micro")["sku"], F.lit("")), _text(F.col("css_sku")),
    ]
    return facts.withColumn("sku", clean_text(F.coalesce(*options)))


def extract_descriptions(facts: DataFrame) -> DataFrame:
    """Theme markup; the short one also from structured data or meta, escaped in a paragraph."""
    plain = F.coalesce(
        F.nullif(F.col("ld_description"), F.lit("")),
        meta_value(F.col("metas"), "og:description", "description"),
    )
    short, long = F.col("css_short_description"), F.col("css_long_description")
    return facts.select(
        "*",
        F.when(short.isNotNull(), short["html"])
        .when(plain != "", F.concat(F.lit("<p>"), html_escape(plain), F.lit("</p>")))
        .otherwise(F.lit("")).alias("short_description"),
        F.when(short.isNotNull(), short["source"]).when(plain != "", F.lit("jsonld/meta"))
        .alias("by_short_description"),
        F.coalesce(long["html"], F.lit("")).alias("long_description"),
        long["source"].alias("by_long_description"),
    )


def extract_image_fields(facts: DataFrame, selectors: dict = SELECTORS) -> DataFrame:
    """All images of a page; ``selectors`` are those the facts were read with."""
    read = facts.withColumn(
        "_images",
        built_once(
            ("images", repr(selectors)),
            lambda: extract_images(
                F.col("el"), F.col("metas"), F.col("ld_images"), F.col("micro")["image"], F.col("url"), selectors
            ),
        ),
    )
    none = F.array().cast("array<string>")
    return read.select(
        "*",
        dedupe_image_variants(F.coalesce(F.col("_images.images"), none)).alias("images"),
        F.col("_images.source").alias("by_images"),
    ).drop("_images")


def _provenance() -> Column:
    tracked = [
        "title", "price", "categories", "brand", "short_description", "long_description", "images",
    ]
    pairs = F.array(
        *[F.struct(F.lit(f).alias("k"), F.col(f"by_{f}").alias("v")) for f in tracked]
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def parse_products(pages: DataFrame, selectors: dict = SELECTORS) -> DataFrame:
    """Product records of ``pages(url, html, ...)``; pages without HTML give no row.

    Other input columns are carried along. A page that cannot be read gives a blank record
    whose ``extracted_by`` holds the error.
    """
    carried = [F.col(c) for c in pages.columns if c not in ("url", "html")]
    facts = page_facts(pages, selectors)
    for step in (
        extract_title, extract_price, extract_availability, extract_categories, extract_brand,
        extract_sku, extract_descriptions,
    ):
        facts = step(facts)
    facts = extract_image_fields(facts, selectors)
    broken = first_of(of_tag(F.col("el"), ERROR_TAG))

    def unless_broken(name, blank):
        return F.when(broken.isNotNull(), blank).otherwise(F.col(name)).alias(name)

    text, none = F.lit(""), F.array().cast("array<string>")
    return facts.select(
        unless_broken("title", text), unless_broken("brand", F.lit(UNKNOWN_BRAND)),
        unless_broken("price", text), F.coalesce(F.col("url"), text).alias("url"),
        unless_broken("categories", none), unless_broken("images", none),
        unless_broken("short_description", text), unless_broken("long_description", text),
        unless_broken("price_value", F.lit(None).cast("double")), unless_broken("currency", text),
        unless_broken("sku", text), unless_broken("availability", text),
        unless_broken("in_stock", F.lit(None).cast("boolean")),
        F.when(broken.isNotNull(), F.create_map(F.lit("error"), F.element_at(broken["texts"], 1)))
        .otherwise(_provenance()).alias("extracted_by"),
        *carried,
    )


def failures(parsed: DataFrame, fetched: DataFrame) -> DataFrame:
    """``(url, reason)``: the reason of a failed fetch, no product data, or the reader's error.

    ``fetched`` has ``(url, outcome, reason)``.
    """
    lost = fetched.where(F.col("outcome") != "ok").select(
        "url", F.coalesce("reason", F.lit("fetch failed")).alias("reason")
    )
    unread = parsed.where(F.coalesce(F.col("title"), F.lit("")) == "").select(
        "url",
        F.coalesce(
            F.try_element_at(F.col("extracted_by"), F.lit("error")),
            F.lit("no product data found in page"),
        ).alias("reason"),
    )
    return lost.unionByName(unread)
