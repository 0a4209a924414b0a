"""Session-level helpers: where scratch data goes, cutting lineage, global positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

CHECKPOINT_CONF = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only on a local master."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="shelfmark-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: later steps and retries re-read, not re-run."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the shared folder, so a lost executor costs a re-read and not a re-run."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def with_global_index(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """Add a dense 0-based rank over the whole table without a single-partition window.

    Rows are range-partitioned by ``order`` and numbered inside each partition; the result is
    checkpointed, so that the partition offsets and the rows come from the same layout. The
    offsets table has one row per partition.
    """
    local = "_local"
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(local, F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright(local, 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col(local).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_offset", local)
    )


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan of few splits a partition per core; a scan that has enough is left alone.

    For inputs of one small file in front of work that is heavy per row. Only for plain scans:
    asking a plan with shuffles for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shares(scan: DataFrame) -> int | None:
    """Partitions for a join that makes rows of a scan much wider; None leaves a small scan to the session.

    The session sizes partitions by the bytes that are shuffled before rows grow. Each split of a
    scan becomes sixteen partitions here, so what one task holds does not follow the table's size.
    Only for plain scans.
    """
    splits = scan.rdd.getNumPartitions()
    if 2 * splits < scan.sparkSession.sparkContext.defaultParallelism:
        return None
    return max(16 * splits, int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_BUILT: dict = {}


def built_once(key, build):
    """Reuse large column expressions within one application; building them is driver time."""
    context = SparkContext._active_spark_context
    slot = (context.applicationId, key)
    if slot not in _BUILT:
        _BUILT[slot] = build()
    return _BUILT[slot]
