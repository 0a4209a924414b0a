"""Streaming queries: the log and the attempts arrive as files, and end where the batch ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators.exports import append_product_log, read_published
from shelfmark.streaming.buckets import read_buckets
from shelfmark.plans.crawl_queries import BLOCKS_SQL, CONTEXT_SQL, MEMO_SQL, context_events, judged, memo_rows, observations
from shelfmark.plans.log_queries import LATEST
from shelfmark.plans.registry import query
from shelfmark.plans.tables import ATTEMPT_ORDER, EXTRA, ORDER, product_log, table
from shelfmark.runtime import scratch_path
from shelfmark.streaming import jobs as S

BATCHES = 3
# A small part of the record, to keep the rest out of the state.
RECORD = ["title", "url", "brand", "categories", "images"]


def _appended(spark, sf):
    """The log written by three appends, oldest part first."""
    path = scratch_path(spark, "stream-log")
    log = product_log(spark, sf).select(*RECORD, *ORDER, "site")
    for part in range(BATCHES):
        append_product_log(log.where(F.col("l_orderkey") % BATCHES == part), path)
    return path


def _stream(spark, sf):
    path = _appended(spark, sf)
    files = spark.read.text(path).inputFiles()
    stream = S.stream_product_log(spark, path, EXTRA, max_files=-(-len(files) // BATCHES))
    return stream.select(*RECORD, "site", *ORDER)


def _follow(spark, df, parts, job):
    """A table grows by the rows of each of ``parts``; the stream runs on after each, as one batch."""
    path, checkpoint = scratch_path(spark, "arriving"), scratch_path(spark, "checkpoint")
    for part in parts:
        df.where(part).write.mode("append").parquet(path)
        job(spark.readStream.schema(df.schema).parquet(path), checkpoint)


def _mixed(event):
    return [event % BATCHES == part for part in range(BATCHES)]


@query("stream_product_log", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey")
def stream_product_log(spark, sf):
    """Every record of every append is seen once."""
    target = scratch_path(spark, "seen")

    def step(batch, batch_id):
        batch.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    S.run_batches(_stream(spark, sf), scratch_path(spark, "checkpoint"), step)
    return spark.read.parquet(target).groupBy("l_partkey").agg(F.sum("n").alias("n"))


@query("upsert_latest", LATEST + " SELECT url, title, l_orderkey AS last_order, first_orderkey AS first_order FROM latest")
def upsert_latest(spark, sf):
    target = scratch_path(spark, "latest")
    S.upsert_latest(_stream(spark, sf), target, scratch_path(spark, "checkpoint"), ORDER)
    return read_buckets(spark, target).select(
        "url", "title", F.col("l_orderkey").alias("last_order"), F.col("first.l_orderkey").alias("first_order")
    )


@query("stream_stats", LATEST + """
SELECT count(*) AS total_products,
  (SELECT count(DISTINCT c) FROM (SELECT unnest(categories) AS c FROM latest WHERE title <> '')) AS total_categories,
  count(DISTINCT CASE WHEN title <> '' AND brand <> 'Unknown' THEN brand END) AS total_brands,
  CAST(sum(CASE WHEN title <> '' THEN len(images) ELSE 0 END) AS BIGINT) AS total_images FROM latest""")
def stream_stats(spark, sf):
    target, stats = scratch_path(spark, "latest"), scratch_path(spark, "stats")
    S.stream_stats(_stream(spark, sf), target, stats, scratch_path(spark, "checkpoint"), ORDER)
    return read_published(spark, stats)


@query("stream_progress", """SELECT count(*) AS current, 2 * count(*) AS total,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS eta FROM events""")
def stream_progress(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    target, total = scratch_path(spark, "progress"), 2 * events.count()
    _follow(spark, events, _mixed(F.col("event_id")), lambda stream, checkpoint: S.stream_progress(stream, target, checkpoint, total))
    return read_published(spark, target).select("current", "total", F.round("eta", 0).alias("eta"))


@query("stream_host_blocks", BLOCKS_SQL)
def stream_host_blocks(spark, sf):
    found = judged(spark, sf).select("event_id", "ts", "host", "outcome", "profile")
    target = scratch_path(spark, "blocks")
    parts = _mixed(F.col("event_id"))
    _follow(spark, found, parts, lambda stream, checkpoint: S.stream_host_blocks(stream, target, checkpoint, ATTEMPT_ORDER))
    return read_buckets(spark, target).select("host", "blocked", "exhausted", F.coalesce("profile", F.lit("")).alias("profile"))


@query("stream_price_context", CONTEXT_SQL)
def stream_price_context(spark, sf):
    """A product's observations come in several batches: they are cut by event number."""
    seen = observations(spark, sf).drop("ts")
    target = scratch_path(spark, "context")
    parts = _mixed(F.floor(F.col("event_id") / 50))
    _follow(spark, seen, parts, lambda stream, checkpoint: S.stream_price_context(stream, target, checkpoint, ["event_id"]))
    known = read_published(spark, target)
    return known.select("host", F.coalesce("preferred_param", F.lit("")).alias("preferred_param"), "misses", "state")


@query("stream_context_memo", MEMO_SQL)
def stream_context_memo(spark, sf):
    """Every batch brings events from all of each host's log."""
    seen, target = context_events(spark, sf), scratch_path(spark, "memo")
    job = lambda stream, checkpoint: S.stream_context_memo(stream, target, checkpoint, ["event_id"], F.floor(F.col("event_id") / 1000))
    _follow(spark, seen, _mixed(F.col("event_id")), job)
    return memo_rows(read_buckets(spark, target))
