"""Export projections and writers. All write with Spark, partitioned where stores differ."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from shelfmark.functions.text import clean_html, raw_description, strip, strip_control
from shelfmark.operators.catalogue import distinct_list, distinct_values, has_title
from shelfmark.runtime import cut_lineage
from shelfmark.schema import EXPORT_FIELDS, export_rows
from shelfmark.sources.logs import path_exists

FORMATS = ["json", "csv", "excel", "xml", "categories", "brands"]


def with_descriptions(df: DataFrame, clean: bool = True) -> DataFrame:
    """Descriptions as plain text, or as they are with break tags as newlines."""
    change = clean_html if clean else raw_description
    return df.withColumns({c: change(F.col(c)) for c in ("short_description", "long_description")})


def feed_rows(df: DataFrame, clean: bool = True, keep: tuple = ()) -> DataFrame:
    """Rows of the flat feeds: titled records only, in export order."""
    return export_rows(with_descriptions(df.where(has_title()), clean), keep)


def excel_rows(df: DataFrame, clean: bool = True, keep: tuple = ()) -> DataFrame:
    """The same rows under spreadsheet headers, without control characters."""
    rows = feed_rows(df, clean, keep)
    return rows.select(
        *[strip_control(F.col(f)).alias(f.replace("_", " ").title()) for f in EXPORT_FIELDS],
        *[F.col(c) for c in keep],
    )


def _writer(df: DataFrame, partition: str | None):
    if partition is None:
        return df.write.mode("errorifexists")
    # Files per store of an even size: large stores are split, small ones share a task.
    return df.hint("rebalance", partition).write.mode("errorifexists").partitionBy(partition)


def append_product_log(df: DataFrame, path: str) -> None:
    """Append one JSON line per product; each append is new compressed files, which streams can follow."""
    df.write.mode("append").option("ignoreNullFields", False).option("compression", "gzip").json(path)


def export_json(df: DataFrame, path: str, clean: bool = True, partition: str | None = None) -> None:
    """All records, untitled ones too, with nested lists."""
    _writer(with_descriptions(df, clean), partition).option("ignoreNullFields", False).json(path)


def export_csv(df: DataFrame, path: str, clean: bool = True, partition: str | None = None) -> None:
    rows = feed_rows(df, clean, (partition,) if partition else ())
    _csv(rows, path, partition)


def _csv(rows: DataFrame, path: str, partition: str | None) -> None:
    (
        _writer(rows, partition)
        .option("header", True).option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def export_excel_rows(df: DataFrame, path: str, clean: bool = True, partition: str | None = None) -> None:
    _csv(excel_rows(df, clean, (partition,) if partition else ()), path, partition)


def export_xml(df: DataFrame, path: str, clean: bool = True, partition: str | None = None) -> None:
    """``<products><product>`` with every field in order, empty ones as empty tags."""
    rows = feed_rows(df, clean, (partition,) if partition else ())
    _writer(rows, partition).format("xml").options(
        rowTag="product", rootTag="products", nullValue=""
    ).save(path)


def list_rows(df: DataFrame, field: str, header: str, drop_unknown: bool = True, drop_blank: bool = True) -> DataFrame:
    """Sorted distinct values of a field under a header."""
    return distinct_list(df, field, drop_unknown, drop_blank).orderBy("value").select(F.col("value").alias(header))


def export_distinct_list(df: DataFrame, path: str, field: str, header: str, partition: str | None = None) -> None:
    if partition is None:
        list_rows(df, field, header).write.option("header", True).option("escape", '"').csv(path)
        return
    values = distinct_list(df, field, by=(partition,)).withColumnRenamed("value", header)
    ordered = values.repartitionByRange(partition, header).sortWithinPartitions(partition, header)
    ordered.write.partitionBy(partition).option("header", True).option("escape", '"').csv(path)


def _written_rows(spark, fmt: str, path: str) -> DataFrame:
    """``(site, rows)``: the rows that the files of a format hold."""
    one = "value string, site string"
    if fmt == "json":
        back = spark.read.schema(one).text(path)
    elif fmt == "xml":
        back = spark.read.format("xml").option("rowTag", "product").schema("url string, site string").load(path)
    else:
        # quoted values may hold line breaks
        back = spark.read.schema(one).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.groupBy("site").agg(F.count(F.lit(1)).alias("rows"))


def export_bundle(df: DataFrame, root: str, sites: list | None = None, formats: list = FORMATS,
                  clean: bool = True, writers: dict | None = None) -> DataFrame:
    """Write every format for every site, one partitioned job a format.

    Returns ``(site, format, path, rows, error)``. ``rows`` are counted in the files that were
    written, by store; what the source would have given is one aggregation over it, and where the
    two differ ``error`` says so. A format that fails is recorded, has no rows, and the others go
    on. Stores of ``sites`` without records have rows of zero. ``writers`` adds formats of a user,
    or replaces some: ``name -> function(df, path, clean, partition)`` that writes one JSON line
    for each titled record, under folders by ``partition``.
    """
    spark = df.sparkSession
    own = writers or {}
    chosen = cut_lineage(df if sites is None else df.where(F.col("site").isin(sites)))
    errors, found = {}, []
    for fmt in formats:
        target = f"{root}/{fmt}"
        try:
            if fmt in own:
                own[fmt](chosen, target, clean, "site")
            elif fmt == "json":
                export_json(chosen, target, clean, "site")
            elif fmt == "csv":
                export_csv(chosen, target, clean, "site")
            elif fmt == "excel":
                export_excel_rows(chosen, target, clean, "site")
            elif fmt == "xml":
                export_xml(chosen, target, clean, "site")
            elif fmt == "categories":
                export_distinct_list(chosen, target, "categories", "Category Name", "site")
            elif fmt == "brands":
                export_distinct_list(chosen, target, "brand", "Brand Name", "site")
            else:
                raise ValueError(f"unknown format {fmt}")
            rows = _written_rows(spark, "json" if fmt in own else fmt, target)
            found.append(rows.select("site", F.lit(fmt).alias("format"), "rows"))
        except Exception as problem:  # one bad format must not cost the others
            errors[fmt] = f"{type(problem).__name__}: {problem}"
    none = F.array().cast("array<string>")
    plain = F.struct(
        F.lit(1).alias("all"), has_title().cast("int").alias("titled"),
        F.lit("").alias("kind"), F.lit("").alias("value"),
    )

    def values(kind, column):
        # the rule of the written lists: tested, then trimmed, then distinct
        kept = F.filter(column, lambda v: ~F.coalesce(v, F.lit("")).isin("", "Unknown") & (strip(v) != ""))
        return F.transform(
            kept,
            lambda v: F.struct(
                F.lit(0).alias("all"), F.lit(0).alias("titled"), F.lit(kind).alias("kind"), strip(v).alias("value")
            ),
        )

    facts = F.concat(
        F.array(plain), values("categories", F.coalesce("categories", none)), values("brands", F.array("brand"))
    )
    counts = (
        chosen.select("site", F.explode(facts).alias("f"))
        .groupBy("site", "f.kind", "f.value").agg(F.sum("f.all").alias("all"), F.sum("f.titled").alias("titled"))
        .groupBy("site").agg(
            F.sum("all").alias("all"), F.sum("titled").alias("titled"),
            F.count_if(F.col("kind") == "categories").alias("categories"),
            F.count_if(F.col("kind") == "brands").alias("brands"),
        )
    )
    if sites is not None:  # a requested store without records has its rows too
        asked = spark.createDataFrame([(s,) for s in dict.fromkeys(sites)], "site string")
        counts = asked.join(counts, "site", "left").fillna(0)
    rows_of = {"json": "all", "categories": "categories", "brands": "brands"}
    steps = F.array(*[
        F.struct(
            F.lit(fmt).alias("format"), F.lit(f"{root}/{fmt}").alias("root"),
            F.col("titled" if fmt in own else rows_of.get(fmt, "titled")).alias("due"),
            F.lit(errors.get(fmt)).cast("string").alias("failure"),
        )
        for fmt in formats
    ])
    due = counts.select("site", F.explode(steps).alias("s")).select("site", "s.*")
    written = functools.reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "site string, format string, rows long")
    rows = F.coalesce("rows", F.lit(0))
    short = F.when(rows != F.col("due"), F.format_string("wrote %d of %d rows", rows, F.col("due")))
    return due.join(written, ["site", "format"], "left").select(
        "site", "format", F.concat("root", F.lit("/site="), "site").alias("path"),
        rows.alias("rows"), F.coalesce("failure", short).alias("error"),
    )


def publish(df: DataFrame, table: str, version: str) -> None:
    """Write a new version of a table and then name it as the current one.

    Readers resolve the manifest first, so they see the old version whole or the new one whole.
    """
    df.write.mode("overwrite").parquet(f"{table}/version={version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(
        f"{table}/manifest"
    )


def current_version(spark, table: str) -> str | None:
    """Newest published version, by name."""
    if not path_exists(spark, f"{table}/manifest"):
        return None
    row = spark.read.schema("version string").json(f"{table}/manifest").agg(F.max("version")).first()
    return row[0]


def read_published(spark, table: str) -> DataFrame | None:
    version = current_version(spark, table)
    return None if version is None else spark.read.parquet(f"{table}/version={version}")


def write_snapshot(products: DataFrame, failed: DataFrame, root: str, version: str) -> None:
    """Products, sorted distinct categories and failures, published as one version each."""
    publish(products, f"{root}/products", version)
    written = read_published(products.sparkSession, f"{root}/products")
    categories = distinct_values(written, "categories").select(F.col("value").alias("category"))
    publish(categories.orderBy("category"), f"{root}/categories", version)
    publish(failed, f"{root}/failures", version)
