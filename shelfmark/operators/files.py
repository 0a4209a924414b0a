"""Product folders and the files in them, as tables of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.paths import image_path, product_dir, safe_path_segment
from shelfmark.functions.text import html_to_markdown, html_to_text
from shelfmark.functions.urls import host_of, site_name, store_host, with_params
from shelfmark.runtime import stored

# File kinds by extension.
FILE_KINDS = {
    "image": ["jpg", "jpeg", "png", "webp", "gif", "svg", "bmp", "avif", "ico"],
    "json": ["json"], "markdown": ["md", "markdown"], "text": ["txt", "log", "csv", "xml"],
}
# Suffixes stored as they are in an archive.
PRECOMPRESSED = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".mp4", ".webm", ".mp3", ".zip", ".gz",
    ".woff", ".woff2", ".ico",
]
STEM_PREFIX = 40
ARCHIVES = {"archive_all": "everything", "archive_data": "data-only", "archive_images": "images-only"}


def file_kind(name: Column) -> Column:
    extension = F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), r"\."), -1))
    out = F.lit("unsupported")
    for kind, extensions in FILE_KINDS.items():
        out = F.when(extension.isin(extensions), kind).otherwise(out)
    return out


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of(name: Column) -> Column:
    """A file name without its extension; leading dots are part of the stem."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def product_documents(products: DataFrame, root: Column) -> DataFrame:
    """``(path, kind, content)``: data.json always, the descriptions where there are any."""
    folder = product_dir(root, F.col("categories"), F.col("title"), F.col("url"))
    record = F.struct(*[F.col(c) for c in products.columns])
    placed = products.select(
        folder.alias("folder"), F.to_json(record, {"ignoreNullFields": "false"}).alias("data"),
        F.coalesce("long_description", F.lit("")).alias("long"),
        F.coalesce("short_description", F.lit("")).alias("short"),
    )
    written = placed.select(
        "folder", "data", html_to_markdown(F.col("long")).alias("long_md"), "long", "short",
        html_to_text(F.col("short")).alias("short_txt"),
    )

    def document(name, content, when):
        return F.when(when, F.struct(F.lit(name).alias("kind"), content.alias("content")))

    documents = F.array(
        document("data.json", F.col("data"), F.lit(True)),
        document("description.md", F.col("long_md"), F.col("long") != ""),
        document("short_description.txt", F.col("short_txt"), F.col("short") != ""),
    )
    return written.select("folder", F.explode(F.array_compact(documents)).alias("d")).select(
        F.concat_ws("/", "folder", "d.kind").alias("path"), "d.kind", "d.content"
    )


def product_folder_index(files: DataFrame) -> DataFrame:
    """``(site, url, folder)`` by the URL in each folder's data.json; the first folder wins.

    ``files(site, path, content)``. A folder counts when it also holds images.
    """
    folders = files.where(name_of(F.col("path")) == "data.json").select(
        "site", parent_of(F.col("path")).alias("folder"),
        F.get_json_object("content", "$.url").alias("url"),
    )
    with_images = (
        files.select("site", parent_of(F.col("path")).alias("_dir"))
        .where(name_of(F.col("_dir")) == "images")
        .select("site", parent_of(F.col("_dir")).alias("folder"))
        .distinct()
    )
    return (
        folders.where(F.coalesce(F.col("url"), F.lit("")) != "")
        .join(with_images, ["site", "folder"], "left_semi")
        .groupBy("site", "url")
        .agg(F.min("folder").alias("folder"))
    )


def _prefixes(text: Column) -> Column:
    """Every non-empty prefix of a text."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substr(text, F.lit(1), n))


def _similar_files(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """Files of a folder whose name is like the wanted one: ``(site, url, src, try, path)``.

    Two stems are alike when the first characters of one are the beginning of the other. That is
    two equi-joins on prefixes: the wanted stem's prefixes with whole stored stems, and the
    wanted stem with the stored stems' prefixes. Stored files are reduced to one per key before
    they are joined, so a folder full of similar names stays linear.
    """
    stem = F.substring(stem_of(F.col("_name")), 1, STEM_PREFIX)
    wanted = asked.select(
        "site", "url", "src", stem.alias("_stem"), F.posexplode(F.array("_computed", "_indexed")).alias("try", "dir")
    ).where("dir is not null")
    stored = listed.join(wanted.select("site", "dir").distinct(), ["site", "dir"], "left_semi").select(
        "site", "dir", "path", F.substring(stem_of(F.col("name")), 1, STEM_PREFIX).alias("key")
    )
    whole = stored.groupBy("site", "dir", "key").agg(F.min("path").alias("path"))
    begun = (
        whole.select("site", "dir", F.explode(_prefixes(F.col("key"))).alias("key"), "path")
        .groupBy("site", "dir", "key").agg(F.min("path").alias("path"))
    )
    keys = ["site", "dir", "key"]
    shorter = wanted.withColumn("key", F.explode(_prefixes(F.col("_stem")))).join(whole, keys)
    longer = wanted.withColumn("key", F.col("_stem")).join(begun, keys)
    columns = ["site", "url", "src", "try", "path"]
    return shorter.select(*columns).unionByName(longer.select(*columns))


def resolve_images(wanted: DataFrame, files: DataFrame, index: DataFrame, root: Column) -> DataFrame:
    """Stored path of each product image, or an empty one, with how it was found.

    ``wanted(site, url, title, categories, src)``; ``files(site, path)``. Two folders are tried,
    the computed one and then the one ``index`` knows for the URL. In each: the exact computed
    path, the same name, a similar name. What is left is looked for in the flat layout of older
    data, then in any folder of the product's name. All of it is equi-joins on whole keys. What
    several joins read is stored once.
    """
    base_name = name_of(F.substring_index(F.coalesce("src", F.lit("")), "?", 1))
    computed = product_dir(root, F.col("categories"), F.col("title"), F.col("url"))
    indexed = index.select("site", "url", F.concat_ws("/", "folder", F.lit("images")).alias("_indexed"))
    asked = stored(wanted.select(
        "site", "url", "src", F.concat_ws("/", computed, F.lit("images")).alias("_computed"),
        base_name.alias("_name"), safe_path_segment(F.col("title")).alias("_folder_name"),
    ).where("_name <> ''").join(indexed, ["site", "url"], "left"), "asked")
    listed = stored(files.select(
        "site", "path", parent_of(F.col("path")).alias("dir"), name_of(F.col("path")).alias("name")
    ), "listed")
    row = ["site", "url", "src"]

    # Ranks: exact path, same name, similar name; 0 to 2 in the first folder, 3 to 5 in the second.
    tries = F.array(*[
        F.struct(F.lit(rank).alias("rank"), path.alias("path"))
        for rank, path in (
            (0, image_path(F.col("_computed"), F.col("src"))),
            (1, F.concat(F.col("_computed"), F.lit("/"), F.col("_name"))),
            (3, image_path(F.col("_indexed"), F.col("src"))),
            (4, F.concat(F.col("_indexed"), F.lit("/"), F.col("_name"))),
        )
    ])
    exact = stored(
        asked.select(*row, F.explode(tries).alias("t")).select(*row, "t.*")
        .where(F.coalesce(F.col("path"), F.lit("")) != "")
        .join(listed.select("site", "path"), ["site", "path"])
        .groupBy(*row).agg(F.min(F.struct("rank", "path")).alias("best")), "exact")
    settled = exact.where("best.rank <= 1").select(*row)
    similar = _similar_files(asked.join(settled, row, "left_anti"), listed).select(
        *row, F.struct((F.col("try") * 3 + 2).alias("rank"), "path").alias("best")
    )
    direct = stored(exact.unionByName(similar).groupBy(*row).agg(F.min("best").alias("best")), "direct")
    parent_name, grand_name = name_of(F.col("dir")), name_of(parent_of(F.col("dir")))
    flat = F.when(grand_name == "images", F.struct(F.lit(6).alias("rank"), parent_name.alias("_folder_name")))
    nested = F.when(parent_name == "images", F.struct(F.lit(7).alias("rank"), grand_name.alias("_folder_name")))
    older = (
        listed.select("site", F.col("name").alias("_name"), "path", F.explode(F.array_compact(F.array(flat, nested))).alias("l"))
        .groupBy("site", F.col("l._folder_name").alias("_folder_name"), "_name")
        .agg(F.min(F.struct("l.rank", "path")).alias("best"))
    )
    legacy = asked.join(direct.select(*row), row, "left_anti").join(older, ["site", "_folder_name", "_name"])
    found = direct.unionByName(legacy.select(*row, "best"))
    how = F.when(F.col("best.rank").isin(2, 5), "near").when(F.col("best.rank") >= 6, "legacy").otherwise("exact")
    return wanted.select(*row).join(found, row, "left").select(
        *row, F.coalesce("best.path", F.lit("")).alias("path"),
        F.when(F.col("best").isNull(), "missing").otherwise(how).alias("how"),
    )


def recover_missing_price(products: DataFrame, variants: DataFrame, ranks: Column, preferred: DataFrame) -> DataFrame:
    """Replace records without any price by the first priced variant of the same URL.

    ``variants(url, param, ...product fields)`` are the pages asked for with a parameter;
    ``ranks`` is a ``map(param, rank)``; ``preferred(host, preferred_param)`` goes first. The
    URL of the original record stays.
    """
    fields = [c for c in products.columns if c != "url"]
    priced = (F.coalesce(F.col("price"), F.lit("")) != "") | F.col("price_value").isNotNull()
    hosted = variants.where(priced).withColumn("host", host_of(F.col("url"))).join(preferred, "host", "left")
    rank = F.struct(
        F.coalesce(F.col("param") != F.col("preferred_param"), F.lit(True)),
        F.coalesce(F.try_element_at(ranks, F.col("param")), F.lit(2**31 - 1)),
        "param",
    )
    best = hosted.groupBy("url").agg(F.min_by(F.struct(*fields), rank).alias("_variant"))
    joined = products.join(best, "url", "left")
    use = ~priced & F.col("_variant").isNotNull()
    return joined.select(
        "url", *[F.when(use, F.col(f"_variant.{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        use.alias("recovered"),
    )


def probe_urls(products: DataFrame, params: Column) -> DataFrame:
    """Addresses to ask for records without a price: ``(url, rank, probe_url)`` per parameter set."""
    unpriced = (F.coalesce(F.col("price"), F.lit("")) == "") & F.col("price_value").isNull()
    return products.where(unpriced).select("url", F.posexplode(params).alias("rank", "params")).select(
        "url", "rank", with_params(F.col("url"), F.col("params")).alias("probe_url")
    )


def archive_manifest(files: DataFrame, kind: str, flatten: bool = False) -> DataFrame:
    """Members of an archive of ``files(site, path)``; paths are relative to the product tree.

    ``flatten`` names images by their product folder alone. ``stored`` marks members that are
    not compressed again.
    """
    path = F.col("path")
    in_images = name_of(parent_of(path)) == "images"
    under_images = F.concat(F.lit("/"), parent_of(path), F.lit("/")).contains("/images/")
    keep = {"archive_all": F.lit(True), "archive_data": ~under_images, "archive_images": in_images}[kind]
    short = F.concat_ws("/", name_of(parent_of(parent_of(path))), name_of(path))
    member = short if flatten and kind == "archive_images" else F.concat_ws("/", F.lit(ARCHIVES[kind]), path)
    stored = F.lower(path).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in PRECOMPRESSED) + ")$")
    return files.where(keep).select("site", "path", member.alias("member"), stored.alias("stored"))


def next_site_version(folders: DataFrame) -> DataFrame:
    """``(site, version)``: the first free number from 2 per site of ``folders(name)``.

    A site's own folder is its name; kept re-scrapes are ``<site>_v<N>_<stamp>``.
    """
    parsed = folders.select(
        F.regexp_extract("name", r"^(.*?)_v([0-9]+)_", 1).alias("site"),
        F.regexp_extract("name", r"^(.*?)_v([0-9]+)_", 2).try_cast("int").alias("v"),
    )
    taken = parsed.where(F.col("site") != "").distinct()
    # A number is free when it is not taken: the answer is 2, or one past a taken number.
    past = taken.select("site", (F.col("v") + 1).alias("v")).where("v > 2")
    sites = folders.where(~F.col("name").rlike("_v[0-9]+_")).select(F.col("name").alias("site"))
    candidates = sites.select("site", F.lit(2).alias("v")).unionByName(past)
    free = candidates.join(taken, ["site", "v"], "left_anti")
    return sites.join(free.groupBy("site").agg(F.min("v").alias("version")), "site")


def validate_store_url(asked: DataFrame, summary: DataFrame, folders: DataFrame) -> DataFrame:
    """``(url, valid, site, products, versions)`` for store addresses ``asked(url)``.

    ``summary(site, products)`` and ``folders(name)`` tell what is on hand.
    """
    versions = (
        folders.select(F.regexp_extract("name", r"^(.*?)_v", 1).alias("site"))
        .where("site <> ''").groupBy("site").agg(F.count(F.lit(1)).alias("versions"))
    )
    host = F.when(F.coalesce("url", F.lit("")) != "", store_host(F.col("url")))
    read = asked.select(
        "url", F.coalesce(host.contains("."), F.lit(False)).alias("valid"), site_name(F.col("url")).alias("_site")
    ).withColumn("site", F.when(F.col("valid"), F.col("_site")))
    return (
        read.join(summary.select("site", "products"), "site", "left")
        .join(versions, "site", "left")
        .select(
            "url", "valid", "site", F.coalesce("products", F.lit(0)).alias("products"),
            F.coalesce("versions", F.lit(0)).alias("versions"),
        )
    )
