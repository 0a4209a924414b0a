"""Product logs and snapshots, per store or over every store under a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions.base import let
from shelfmark.functions.text import float_text
from shelfmark.sources.arrays import read_json_array
from shelfmark.schema import ALL_FIELDS, FIELD_TYPES, LIST_FIELDS, PRODUCT_SCHEMA, normalize_records

LOG_NAME, SNAPSHOT_NAME = "products.jsonl", "products.json"


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a path or glob matches anything."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    matches = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return matches is not None and len(matches) > 0


def _text_of(value: Column) -> Column:
    """Text of a scalar as the log's writer would print it; strings are by far the usual case."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "STRING", text)
        .when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("string"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), float_text(F.try_variant_get(value, "$", "double")))
        .otherwise(text)
    )


def parse_product_lines(lines: DataFrame, extra: dict | None = None) -> DataFrame:
    """Records of a ``value`` column of JSON lines; other columns are carried along.

    Blank lines, torn lines and lines that hold no object give no row. ``extra`` maps names of
    further JSON fields to their types (such as the time and sequence number of a scrape). The
    object is taken apart once, into a struct; only fields that may hold several kinds of value
    stay Variant until their kind is known.
    """
    carried = [c for c in lines.columns if c != "value"]
    direct = {n: t for n, t in FIELD_TYPES.items() if n not in LIST_FIELDS}
    wanted = {n: direct[n].simpleString() if n in direct else "variant" for n in ALL_FIELDS}
    wanted.update(extra or {})
    record = f"struct<{','.join(f'{n}:{t}' for n, t in wanted.items())}>"
    # A filter on the parsed object would be pushed below it and parse every line twice.
    objects = F.filter(F.array(F.try_variant_get(F.try_parse_json("value"), "$", record)), lambda r: r.isNotNull())
    parsed = lines.where(F.col("value").rlike(r"^[\s\x1c-\x1f\u00a0\ufeff]*\{")).select(*carried, F.explode(objects).alias("_r"))
    texts = [n for n in ALL_FIELDS if n not in FIELD_TYPES]

    def listed(name):
        value = F.col(f"_r.{name}")
        alone = F.when(value.isNotNull() & ~F.is_variant_null(value), F.transform(F.array(value), _text_of))
        return F.coalesce(F.try_variant_get(value, "$", "array<string>"), alone).alias(name)

    # One expression a field, so that fields nobody asks for cost nothing; ``let`` keeps it short.
    fields = {n: let(F.col(f"_r.{n}"), _text_of).alias(n) for n in texts}
    fields |= {n: listed(n) for n in LIST_FIELDS} | {n: F.col(f"_r.{n}").alias(n) for n in [*direct, *(extra or {})]}
    return normalize_records(parsed.select(*fields.values(), *carried))


def read_product_log(spark: SparkSession, path: str, extra: dict | None = None) -> DataFrame:
    """A log of one JSON object per line, in any number of files."""
    return parse_product_lines(spark.read.text(path), extra)


def read_product_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot that is one JSON array; missing or unreadable ones are empty.

    Its elements are found by many tasks a file and read like lines of a log.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], PRODUCT_SCHEMA)
    return parse_product_lines(read_json_array(spark, path).select("value"))


def load_products(spark: SparkSession, folder: str, extra: dict | None = None) -> DataFrame:
    """The log of a store when there is one, else its snapshot."""
    log = f"{folder}/{LOG_NAME}"
    if path_exists(spark, log):
        return read_product_log(spark, log, extra)
    return read_product_snapshot(spark, f"{folder}/{SNAPSHOT_NAME}")


def load_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Records a run continues from: the snapshot also stands in for an empty log."""
    products = load_products(spark, folder)
    if products.isEmpty():
        products = read_product_snapshot(spark, f"{folder}/{SNAPSHOT_NAME}")
    return products


def scan_sites(spark: SparkSession, root: str, extra: dict | None = None) -> DataFrame:
    """Logs of every store under ``root`` with ``site`` and ``modified``; hidden folders are skipped.

    A store is a folder ``<site>/products.jsonl`` (a file or a folder of files), or the same with
    Spark's partition names, ``site=<site>/log=products.jsonl``.
    """
    folder = rf"/(?:site=)?([^/]+)/(?:log=)?{LOG_NAME}(?:/[^/]*)?$"
    lines = spark.read.text(f"{root}/*/*{LOG_NAME}").select(
        "value",
        F.try_url_decode(F.regexp_extract("_metadata.file_path", folder, 1)).alias("site"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    return parse_product_lines(lines.where(~F.col("site").startswith(".")), extra)
