"""Keyed tables that a micro-batch changes in part.

Rows lie in buckets by a hash of their key, and a manifest names the folder that holds each bucket
now. A batch reads and rewrites the buckets its keys fall into and no others; a hot bucket is split
over tasks and files like any other data. The manifest is written last, so readers see a batch whole
or not at all; folders named neither by it nor by the one before are removed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfmark.sources.logs import path_exists

_MANIFEST = "version string, buckets int, schema string, folders map<string,string>"


def query_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


@dataclass
class Manifest:
    version: str
    buckets: int
    schema: T.StructType
    folders: dict  # bucket to its folder under the table

    def read(self, spark: SparkSession, table: str, only: list | None = None) -> DataFrame:
        """The table, or those of its buckets."""
        paths = [f"{table}/{f}" for b, f in sorted(self.folders.items()) if only is None or b in only]
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)


def manifest(spark: SparkSession, table: str, not_ending: str | None = None) -> Manifest | None:
    """The newest manifest, or the newest that another query or batch wrote."""
    if not path_exists(spark, f"{table}/manifest"):
        return None
    rows = spark.read.schema(_MANIFEST).json(f"{table}/manifest")
    if not_ending:
        rows = rows.where(~F.col("version").endswith(not_ending))
    row = rows.orderBy(F.desc("version")).first()
    if row is None or row.schema is None:
        return None
    return Manifest(row.version, row.buckets, T.StructType.fromJson(json.loads(row.schema)), {int(b): f for b, f in (row.folders or {}).items()})


def read_buckets(spark: SparkSession, table: str) -> DataFrame | None:
    held = manifest(spark, table)
    return None if held is None else held.read(spark, table)


@dataclass
class Change:
    """What a batch did: rows of the touched buckets before and after, and the version."""

    before: DataFrame
    after: DataFrame
    version: str
    buckets: int


def merge_buckets(batch: DataFrame, table: str, checkpoint: str, batch_id: int, keys: list, merge, buckets: int | None = None) -> Change:
    """Merge rows by ``keys`` into a table: ``merge(before, batch)`` gives the touched buckets' new rows.

    ``before`` has the columns that ``merge`` gives, or is None in the first version. The number of
    buckets is that of the first version, without a wish that of the session's shuffle partitions. A version is named by its place in the table's sequence
    and by the query and batch that wrote it, and starts from the newest that others wrote, so a
    batch that is redone writes the same; a table has one writer at a time.
    """
    spark = batch.sparkSession
    own = f"-{query_id(spark, checkpoint)}-{batch_id:012d}"
    prior = manifest(spark, table, own)
    buckets = prior.buckets if prior else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = f"{int(prior.version.split('-')[0]) + 1 if prior else 0:012d}{own}"
    # In files, which no manifest names: cached, a batch of many keys would leave its own merge too little memory.
    arrived = f"{table}/data/arrived-{version}"
    batch.write.mode("overwrite").parquet(arrived)
    batch = spark.read.schema(batch.schema).parquet(arrived)
    touched = sorted(r[0] for r in batch.select(bucket_of(keys, buckets)).distinct().collect())
    before = prior.read(spark, table, touched) if prior else None
    after = merge(before, batch)
    folder = f"data/{version}"
    placed = after.withColumn("_bucket", bucket_of(keys, buckets))
    placed.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/{folder}")
    written = {int(name.split("=")[1]): f"{folder}/{name}" for name in _names(spark, f"{table}/{folder}") if name.startswith("_bucket=")}
    folders = {b: f for b, f in (prior.folders if prior else {}).items() if b not in touched} | written
    held = Manifest(version, buckets, after.schema, folders)
    row = (version, buckets, after.schema.json(), {str(b): f for b, f in folders.items()})
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{table}/manifest")
    _drop_unnamed(spark, table, [m for m in (prior, held) if m])
    rows = held.read(spark, table, touched)
    return Change(before if before is not None else rows.where(F.lit(False)), rows, version, buckets)


def bucket_of(keys: list, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    system, where = _files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def _drop_unnamed(spark: SparkSession, table: str, kept: list[Manifest]) -> None:
    """Remove the bucket folders that no kept manifest names."""
    named = {f for m in kept for f in m.folders.values()} | {f"data/{m.version}/_SUCCESS" for m in kept}
    for version in _names(spark, f"{table}/data"):
        names = _names(spark, f"{table}/data/{version}")
        gone = [n for n in names if f"data/{version}/{n}" not in named]
        for path in [f"data/{version}"] if len(gone) == len(names) else [f"data/{version}/{n}" for n in gone]:
            system, where = _files(spark, f"{table}/{path}")
            system.delete(where, True)
