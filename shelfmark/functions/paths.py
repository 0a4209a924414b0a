"""Folder and file names for products, kept inside a whole-path length budget."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.base import let
from shelfmark.functions.urls import url_path

# Path budget.
MAX_PATH = 260
SAFETY_MARGIN = 12
MAX_SEGMENT = 60
MIN_SEGMENT = 12
MAX_FILENAME = 100
MIN_FILENAME = 24
IMAGE_RESERVE = 48
CATEGORY_SEGMENT = 40
# Device names no file may carry.
RESERVED = ["con", "prn", "aux", "nul"] + [f"{d}{n}" for d in ("com", "lpt") for n in range(10)]


def _hash(c: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(c, F.lit(""))), 1, 6)


def safe_path_segment(value: Column, max_len: Column | int = MAX_SEGMENT) -> Column:
    """A folder name; longer ones are cut and carry a hash of the original."""
    limit = F.lit(max_len) if isinstance(max_len, int) else max_len

    def shortened(name, original):
        head = F.substr(name, F.lit(1), F.greatest(limit - 7, F.lit(1)))
        head = F.regexp_replace(head, "^_+|_+$", "")
        return F.when(F.length(name) > limit, F.concat(head, F.lit("_"), _hash(original))).otherwise(name)

    def unreserved(cut):
        return (
            F.when(cut == "", F.lit("unnamed"))
            .when(F.lower(cut).isin(RESERVED), F.concat(cut, F.lit("_")))
            .otherwise(cut)
        )

    def segment(original):
        name = F.regexp_replace(F.regexp_replace(original, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
        return let(let(name, lambda n: shortened(n, original)), unreserved)

    return let(F.coalesce(value, F.lit("")), segment)


def _cut_filename(name: Column, seed: Column, limit: Column) -> Column:
    def cut(extension):
        ending = F.when(extension != "", F.concat(F.lit("."), extension)).otherwise(F.lit(""))
        suffix = F.concat(F.lit("_"), _hash(seed), ending)
        stem = F.substr(name, F.lit(1), F.length(name) - F.length(ending))
        return F.concat(F.substr(stem, F.lit(1), F.greatest(limit - F.length(suffix), F.lit(1))), suffix)

    extension = F.regexp_extract(name, r"(?s)\.([^.]{1,5})$", 1)
    return F.when((limit <= 0) | (F.length(name) <= limit), name).otherwise(let(extension, cut))


def safe_filename(url: Column, max_len: Column | int = MAX_FILENAME, fallback: str = "image") -> Column:
    """A file name from the last path part of an image URL."""
    limit = F.lit(max_len) if isinstance(max_len, int) else max_len

    def decoded(encoded):
        text = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
        name = F.regexp_replace(F.coalesce(text, encoded), r'[<>:"/\\|?*\x00-\x1f]|[^\x20-\x7e]', "_")
        return F.regexp_replace(name, r"^[. ]+|[. ]+$", "")

    def finished(name):
        stem = F.lower(F.regexp_replace(name, r"(?s)\.[^.]*$", ""))
        return F.when(stem.isin(RESERVED), F.concat(F.lit("_"), name)).otherwise(name)

    def named(raw):
        name = F.when(raw == "", F.lit(fallback)).otherwise(raw)
        return let(let(name, lambda n: _cut_filename(n, F.coalesce(F.nullif(url, F.lit("")), n), limit)), finished)

    last = F.element_at(F.split(url_path(url), "/"), -1)
    return let(let(last, decoded), named)


def product_dir(root: Column, categories: Column, title: Column, url: Column,
                max_path: int = MAX_PATH, reserve: int = IMAGE_RESERVE) -> Column:
    """Folder of one product: the longest category trail that leaves room for its images.

    Lengths are those of the path as given; pass an absolute ``root`` to budget for one.
    """
    budget = max_path - reserve - len("images") - SAFETY_MARGIN
    title = F.coalesce(title, F.lit(""))
    url = F.coalesce(url, F.lit(""))
    trail = F.filter(
        F.transform(
            F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda c: c != ""),
            lambda c: safe_path_segment(c, CATEGORY_SEGMENT),
        ),
        lambda s: s != "unnamed",
    )
    last_part = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    name = safe_path_segment(F.when(title != "", title).otherwise(last_part))

    def place(trail, name):
        def joined(levels):
            middle = F.when(levels == 0, F.lit("Uncategorized")).otherwise(
                F.array_join(F.slice(trail, 1, levels), "/")
            )
            return F.concat_ws("/", root, middle, name)

        fitting = F.filter(
            F.transform(F.sequence(F.size(trail), F.lit(0), F.lit(-1)), joined),
            lambda p: F.length(p) <= budget,
        )
        base = F.concat_ws("/", root, F.lit("Uncategorized"))
        room = F.greatest(F.lit(budget) - F.length(base) - 1, F.lit(MIN_SEGMENT))
        squeezed = safe_path_segment(F.when(title != "", title).otherwise(url), room)
        return F.coalesce(F.get(fitting, F.lit(0)), F.concat_ws("/", base, squeezed))

    return let(trail, lambda t: let(name, lambda n: place(t, n)))


def image_path(folder: Column, url: Column, max_path: int = MAX_PATH) -> Column:
    """Path of one image under ``folder``; empty when no usable name fits."""

    def within(folder):
        room = F.lit(max_path - 1 - SAFETY_MARGIN) - F.length(folder)
        name = let(F.least(room, F.lit(MAX_FILENAME)), lambda r: safe_filename(url, r))
        return F.when(room < MIN_FILENAME, F.lit("")).otherwise(F.concat_ws("/", folder, name))

    return let(folder, within)
