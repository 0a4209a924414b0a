"""Image candidates of a page: one source per tag, gallery order, resized copies collapsed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.base import first_of, let
from shelfmark.functions.text import SPACE, strip
from shelfmark.functions.urls import absolutize_url, is_junk_image, largest_from_srcset
from shelfmark.operators.elements import (
    first_filled, matched, meta_values, of_tag, rule_ids, rule_numbers, selector_name,
)
from shelfmark.operators.rules import IMAGE_ATTRIBUTES, SELECTORS

_SIZE_SUFFIX = r"(?i)-(\d+)x(\d+)(?=\.[a-z0-9]{2,5}$)"


def image_from_tag(attrs: Column, base: Column) -> Column:
    """Best source of one image tag: the largest of a srcset, else the first usable attribute."""
    sets = F.transform(
        F.array(F.lit("data-srcset"), F.lit("srcset")), lambda n: largest_from_srcset(attrs[n])
    )
    plain = F.transform(
        F.array(*[F.lit(n) for n in IMAGE_ATTRIBUTES]),
        lambda n: F.regexp_extract(attrs[n], f"(?U)^{SPACE}*(\\S+)", 1),
    )
    candidates = F.transform(
        F.filter(F.concat(sets, plain), lambda u: u != ""), lambda u: absolutize_url(u, base)
    )
    return first_filled(F.filter(candidates, lambda u: ~is_junk_image(u)))


def dedupe_image_variants(images: Column) -> Column:
    """One URL per picture: an original beats a resize, a bigger resize a smaller one."""

    def described(url, position):
        area = F.regexp_extract(url, _SIZE_SUFFIX, 1).try_cast("long") * F.regexp_extract(
            url, _SIZE_SUFFIX, 2
        ).try_cast("long")
        resized = F.struct(
            F.regexp_replace(url, _SIZE_SUFFIX, "").alias("base"), F.lit(0).alias("original"),
            F.coalesce(area, F.lit(0)).alias("area"), (-position).alias("first"), url.alias("url"),
        )
        whole = F.struct(
            url.alias("base"), F.lit(1).alias("original"), F.lit(0).cast("long").alias("area"),
            (-position).alias("first"), url.alias("url"),
        )
        return F.when(url.rlike(_SIZE_SUFFIX), resized).otherwise(whole)

    def ends(runs, step):
        """Of each run of one base in a sorted array, the item that has no neighbour of it at ``step``."""
        def beside(i):
            at = i + step
            return F.when((at >= 0) & (at < F.size(runs)), F.get(runs, at)["base"])
        return F.filter(runs, lambda x, i: ~x["base"].eqNullSafe(beside(i)))

    # Sorted twice by base: its best item ends a run of one, its first item starts a run of the other.
    def best_per_base(items):
        best = let(F.array_sort(items), lambda s: ends(s, 1))
        places = F.transform(items, lambda x: F.struct(x["base"].alias("base"), (-x["first"]).alias("place")))
        first = let(F.array_sort(places), lambda s: ends(s, -1))
        chosen = F.zip_with(first, best, lambda f, x: F.struct(f["place"].alias("place"), x["url"].alias("url")))
        return F.transform(F.array_sort(chosen), lambda x: x["url"])

    kept = F.filter(images, lambda u: F.coalesce(u, F.lit("")) != "")
    return let(F.transform(kept, described), best_per_base)


def absolute_images(urls: Column, base: Column) -> Column:
    """Absolute addresses without query strings; furniture dropped."""
    absolute = F.transform(urls, lambda u: absolutize_url(u, base))
    kept = F.filter(absolute, lambda u: ~is_junk_image(u))
    return F.transform(kept, lambda u: F.substring_index(u, "?", 1))


def image_tags(elements: Column, base: Column) -> Column:
    """Per ``<img>``: its place, the rules it matches and its best source."""
    return F.transform(
        of_tag(elements, "img"),
        lambda e: F.struct(
            e["pos"].alias("pos"), e["hits"].alias("hits"),
            F.substring_index(image_from_tag(e["attrs"], base), "?", 1).alias("source"),
        ),
    )


def _sources(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: t["source"]), lambda s: s != ""))


def collect_gallery(structured: Column, tags: Column, selectors: dict = SELECTORS) -> Column:
    """Structured-data images, then gallery after gallery until there is more than one image."""
    start = F.struct(
        structured.alias("images"),
        F.when(F.size(structured) > 0, F.lit("jsonld")).alias("source"),
        F.lit(False).alias("done"),
    )

    def step(state, rule):
        def grow(hits):
            images = F.array_union(state["images"], _sources(hits))
            return let(
                images,
                lambda i: F.struct(
                    i.alias("images"),
                    F.coalesce(
                        state["source"],
                        F.when(
                            F.size(i) > F.size(state["images"]), selector_name("gallery", rule, selectors)
                        ),
                    ).alias("source"),
                    (F.size(i) > 1).alias("done"),
                ),
            )

        grown = let(matched(tags, rule), lambda hits: F.when(F.size(hits) > 0, grow(hits)))
        return F.when(state["done"], state).otherwise(F.coalesce(grown, state))

    return F.aggregate(rule_numbers("gallery", selectors), start, step)


def scanned_images(elements: Column, tags: Column, selectors: dict = SELECTORS) -> Column:
    """Sources of the images of the main region, or of the page when it has none."""
    first, last = rule_ids("region", selectors)
    regions = F.filter(elements, lambda e: F.exists(e["hits"], lambda h: h.between(first, last)))
    within = let(
        first_of(regions),
        lambda r: F.filter(
            tags, lambda t: r.isNull() | ((t["pos"] > r["pos"]) & (t["pos"] < r["stop"]))
        ),
    )
    return _sources(within)


def extract_images(
    elements: Column, metas: Column, structured: Column, micro: Column, base: Column,
    selectors: dict = SELECTORS,
) -> Column:
    """``struct(images, source)`` of a page: galleries, then meta, microdata and page images."""
    # The three lists of plain addresses are resolved in one pass.
    meta = meta_values(metas, "og:image", "og:image:secure_url", "twitter:image")
    lists = F.array(structured, meta, F.array(F.coalesce(micro, F.lit(""))))
    resolved = F.transform(lists, lambda urls: F.array_distinct(absolute_images(urls, base)))

    def option(images, source):
        return F.struct(images.alias("images"), source.alias("source"))

    def choose(found, tags):
        gallery = collect_gallery(found[0], tags, selectors)
        options = F.array(
            let(gallery, lambda g: option(g["images"], g["source"])),
            option(found[1], F.lit("opengraph")),
            option(found[2], F.lit("microdata")),
            option(scanned_images(elements, tags, selectors), F.lit("content-scan")),
        )
        return first_of(F.filter(options, lambda o: F.size(o["images"]) > 0))

    return let(resolved, lambda f: let(image_tags(elements, base), lambda t: choose(f, t)))
