"""JSON documents that are one array, as rows of their elements, read by many tasks a file.

A file is read in pieces between commas, split by bytes like lines of a log. Whether a comma ends an
element depends on all before it: on the state of quotes, and on how deep brackets are nested. What
a piece does to that state is known without what came before it: it turns quoting over or not, and
adds to the depth one number if it begins outside a text and another if it begins inside. Such
effects add up, first along a split's pieces and then over the splits of a file, so no task sees a
whole file. Indented and one-line arrays are read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelfmark.runtime import cut_lineage

_SPACE = " \t\r\n﻿"


def _depth(outside: Column) -> Column:
    """Opening less closing brackets of text that holds no quoted parts."""
    opened = F.length(F.regexp_replace(outside, r"[^\[{]", ""))
    return (opened - F.length(F.regexp_replace(outside, r"[^\]}]", ""))).cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value, turns, d0, d1): a piece, whether it turns quoting over, and what it
    adds to the depth where it begins outside (d0) or inside (d1) a text."""
    raw = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # an escaped quote is none
    quotes = F.length(F.regexp_replace(F.col("_plain"), r"[^\"]", ""))
    texts = r"\"[^\"]*\"?"
    rest = F.regexp_replace(F.regexp_replace(F.col("_plain"), r"^[^\"]*", ""), r"^\"", "")
    return cut_lineage(raw.withColumn("_plain", plain).select(
        "file", "split", "at", "value", (quotes % 2).alias("turns"),
        _depth(F.regexp_replace("_plain", texts, "")).alias("d0"), _depth(F.regexp_replace(rest, texts, "")).alias("d1")))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """``(file, element, value)``: the JSON text of each element of the array in each file, numbered from 0.

    Files that hold anything but one array, or that end within it, give no rows, like missing ones do.
    """
    along = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = _pieces(spark, path)
    turned = F.coalesce(F.sum("turns").over(along), F.lit(0))
    held = pieces.withColumn("_odd", turned % 2)  # whether quoting is turned over between the split's start and here
    for s in (0, 1):  # as if the split began outside or inside a text
        change = F.when((F.col("_odd") + s) % 2 == 0, F.col("d0")).otherwise(F.col("d1"))
        held = held.withColumn(f"_change{s}", change)
    to_here = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.select("*", *[F.sum(f"_change{s}").over(to_here).alias(f"_deep{s}") for s in (0, 1)])

    # One row a split: the state it begins in, from what all before it do.
    splits = held.groupBy("file", "split").agg(
        (F.sum("turns") % 2).alias("turns"), *[F.sum(f"_change{s}").alias(f"sum{s}") for s in (0, 1)],
        F.min_by("value", "at").alias("first"), F.max_by("value", "at").alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    splits = splits.withColumn("sum", F.when(F.col("inside") == 0, F.col("sum0")).otherwise(F.col("sum1")))
    splits = splits.withColumn("deep", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    whole = splits.groupBy("file").agg(
        F.sum("sum").alias("end"), (F.sum("turns") % 2).alias("open"), F.min_by("first", "split").alias("first"), F.max_by("last", "split").alias("last"))
    whole = whole.where((F.col("end") == 0) & (F.col("open") == 0) & F.ltrim(F.col("first"), F.lit(_SPACE)).startswith("[") & F.rtrim(F.col("last"), F.lit(_SPACE)).endswith("]"))
    starts = splits.join(whole.select("file"), "file", "left_semi").select("file", "split", "inside", "deep")

    outside = (F.col("inside") + F.col("_odd") + F.col("turns")) % 2 == 0
    deep = F.col("deep") + F.when(F.col("inside") == 0, F.col("_deep0")).otherwise(F.col("_deep1"))
    placed = held.join(starts, ["file", "split"]).select("file", "split", "at", "value", (outside & (deep == 1)).cast("long").alias("ends"), (outside & (deep <= 0)).alias("closed"))
    # Elements are numbered by the commas that end them.
    placed = placed.withColumn("_number", F.coalesce(F.sum("ends").over(along), F.lit(0)))
    numbers = placed.groupBy("file", "split").agg(F.sum("ends").alias("n"), F.count_if("closed").alias("closed"))
    numbers = numbers.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    element = F.col("from") + F.col("_number")
    parts = placed.drop("closed", "ends").join(numbers.select("file", "split", "from"), ["file", "split"])
    rows = parts.groupBy("file", element.alias("element")).agg(
        F.sort_array(F.collect_list(F.struct("split", "at", "value")))["value"].alias("values"), F.lit(1).alias("one"))
    last = numbers.groupBy("file").agg(F.sum("n").alias("last"), F.sum("closed").alias("closed")).where("closed = 1")
    text = F.concat_ws(",", "values")
    text = F.when(F.col("element") == 0, F.substr(F.ltrim(text, F.lit(_SPACE)), F.lit(2))).otherwise(text)
    rows = rows.join(last, "file").withColumn("_text", text)
    ending = F.rtrim("_text", F.lit(_SPACE))
    value = F.when(F.col("element") == F.col("last"), F.substr(ending, F.lit(1), F.length(ending) - 1)).otherwise(F.col("_text"))
    return rows.select("file", "element", F.trim(value, F.lit(_SPACE)).alias("value")).where("value <> ''")
