"""What a crawler leaves behind: page archives, queues, run logs, small JSON lists."""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions.text import strip
from shelfmark.functions.urls import html_cache_key
from shelfmark.sources.arrays import read_json_array


def write_page_archive(pages: DataFrame, path: str) -> int:
    """Store each of ``pages(url, html)`` as ``<sha1 of the URL>.html.gz`` in the folder ``path``; how many.

    ``path`` must be one that executors reach by Arrow's file systems. Files are written beside and
    moved, so a repeated task replaces a file by an equal one. Of pages with one key one stays; pages
    without text are empty files.
    """
    spark = pages.sparkSession
    system, folder = pa.fs.FileSystem.from_uri(path)
    system.create_dir(folder)

    def write(batches):
        system, folder = pa.fs.FileSystem.from_uri(path)
        n = 0
        for batch in batches:
            for key, html in zip(*batch.columns):
                beside = f"{folder}/.{key}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside, compression=None) as f:
                    f.write(gzip.compress(html.as_py() or b"", 6, mtime=0))
                system.move(beside, f"{folder}/{key}.html.gz")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    # Each file waits for its folder more than it computes, so tasks go by the session's partitions, not by bytes.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pages.select(html_cache_key(F.col("url")).alias("key"), F.col("html").cast("binary").alias("html"))
    return sum(r.n for r in keyed.repartition(parts, "key").mapInArrow(write, "n long").collect())


def read_page_archive(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """Archived pages of ``urls(url, ...)``, stored as ``<sha1 of the URL>.html.gz``.

    A corrupt or missing entry is a miss: such URLs give no row.
    """
    files = (
        spark.read.option("ignoreCorruptFiles", True).text(path, wholetext=True)
        .select(
            F.regexp_extract("_metadata.file_path", r"/(?:[^/]*=)?([0-9a-f]{40})\.html", 1).alias("_key"),
            F.col("value").alias("html"),
        )
    )
    return urls.withColumn("_key", html_cache_key(F.col("url"))).join(files, "_key").drop("_key")


def read_url_queue(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank lines."""
    return parse_url_queue(spark.read.text(path))


def parse_url_queue(lines: DataFrame) -> DataFrame:
    return lines.select(strip(F.col("value")).alias("url")).where("url <> ''")


def severity(line: Column) -> Column:
    """error, warning, success or plain, by the words a line holds."""
    return (
        F.when(line.contains("ERROR"), "error")
        .when(line.contains("WARNING"), "warning")
        .when(line.contains("finished") | line.contains("complete"), "success")
        .otherwise("plain")
    )


def parse_scrape_log(lines: DataFrame) -> DataFrame:
    """``(ts, level, message, severity)`` of lines like ``ts - LEVEL - message``."""
    value = F.col("value")
    rest = F.regexp_extract(value, r"(?s)^.*? - .*? - (.*)$", 1)
    return lines.select(
        F.substring_index(value, " - ", 1).alias("ts"),
        F.nullif(F.regexp_extract(value, r"- (INFO|ERROR|WARNING|DEBUG) -", 1), F.lit("")).alias("level"),
        F.when(rest == "", value).otherwise(rest).alias("message"),
        severity(value).alias("severity"),
        *[F.col(c) for c in lines.columns if c != "value"],
    )


def read_scrape_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_scrape_log(spark.read.text(path))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """The names of a JSON array, as ``category``, in any layout; other kinds of elements are left out."""
    names = read_json_array(spark, path).select(F.try_variant_get(F.try_parse_json("value"), "$", "variant").alias("v"))
    return names.where(F.schema_of_variant("v") == "STRING").select(F.try_variant_get("v", "$", "string").alias("category"))


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """``(url, reason)`` of a JSON array of such objects, in any layout."""
    return read_json_array(spark, path).select(F.from_json("value", "url string, reason string").alias("f")).where("f is not null").select("f.*")
