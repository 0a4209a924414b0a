"""Structured Streaming over product logs, attempts and price observations.

State that grows with the data lives in tables of buckets by key (``buckets``): a micro-batch is
first reduced with map-side combine, then merged into the buckets it touches. No key is handled by
one Python call, so a host or URL with most of the rows is no special case. Redoing a batch writes
the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.operators.catalogue import has_title, latest_per_url
from shelfmark.operators.context import folded, stretches, told
from shelfmark.operators.exports import publish, read_published
from shelfmark.operators.quality import EXHAUSTED_AFTER, PROBE_LIMIT
from shelfmark.schema import UNKNOWN_BRAND
from shelfmark.sources.logs import parse_product_lines, path_exists
from shelfmark.streaming.buckets import merge_buckets, query_id


def stream_product_log(spark: SparkSession, path: str, extra: dict | None = None, max_files: int | None = None) -> DataFrame:
    """New records as files arrive. One append is one or more new files; a file that grows in
    place is not read again, so writers use ``append_product_log``."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_product_lines(reader.load(path), extra)


def _state(spark: SparkSession, table: str, checkpoint: str, batch_id: int) -> tuple[DataFrame | None, str]:
    """State before this batch, and the version that the batch publishes.

    A version is named by its place in the table's sequence and by the query and batch that wrote
    it. What another query or an earlier batch wrote is prior state; what this batch wrote before
    is not, so a batch that is redone gives the same version, and a query that starts from a new
    checkpoint adds to the table. A table has one writer at a time.
    """
    own = f"-{query_id(spark, checkpoint)}-{batch_id:012d}"
    newest = None
    if path_exists(spark, f"{table}/manifest"):
        versions = spark.read.schema("version string").json(f"{table}/manifest")
        newest = versions.where(~F.col("version").endswith(own)).agg(F.max("version")).first()[0]
    if newest is None:
        return None, f"{0:012d}{own}"
    return spark.read.parquet(f"{table}/version={newest}"), f"{int(newest.split('-')[0]) + 1:012d}{own}"


def run_batches(stream: DataFrame, checkpoint: str, step, available_now: bool = True, interval: str = "1 second"):
    """Start a query that hands every micro-batch to ``step(batch, batch_id)``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    if available_now:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    return writer.trigger(processingTime=interval).start()


def upsert_latest(stream: DataFrame, table: str, checkpoint: str, order: list, on_batch=None, buckets: int | None = None, **options):
    """Keep the latest record per URL in ``table``, in buckets by URL, of which a batch rewrites those it touches.

    Records without a URL are all kept. ``first`` is where a URL was first seen. ``on_batch(change,
    urls, batch_id)`` sees the touched buckets before and after, and the batch's keys.
    """

    def step(batch, batch_id):
        newest = latest_per_url(batch, order).withColumn("first", F.col("position.first")).drop("position")
        payload = [c for c in batch.columns if c != "url"]
        own = F.when(F.coalesce(F.col("url"), F.lit("")) == "", F.struct(*order))

        def merge(before, arrived):
            rows = arrived if before is None else before.unionByName(arrived)
            return (
                rows.groupBy("url", own.alias("_own"))
                .agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_r"), F.min("first").alias("first"))
                .select("url", *[F.col(f"_r.{c}").alias(c) for c in payload], "first")
            )

        change = merge_buckets(newest, table, checkpoint, batch_id, ["url"], merge, buckets)
        if on_batch:
            on_batch(change, newest.select("url", own.alias("_own")), batch_id)

    return run_batches(stream, checkpoint, step, **options)


def _references(products: DataFrame, sign: int) -> DataFrame:
    """(kind, value, n): what records add to the statistics, or take from them."""
    none = F.array().cast("array<string>")
    titled = has_title()
    brand = F.filter(F.array("brand"), lambda b: ~F.coalesce(b, F.lit("")).isin("", UNKNOWN_BRAND))

    def rows(kind, values):
        kept = F.when(titled, F.coalesce(values, none)).otherwise(none)
        return F.transform(kept, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(sign).cast("long").alias("n")))

    images = F.when(titled, F.coalesce(F.size("images"), F.lit(0))).otherwise(0) * sign
    whole = F.array(
        F.struct(F.lit("products").alias("kind"), F.lit("").alias("value"), F.lit(sign).cast("long").alias("n")),
        F.struct(F.lit("images").alias("kind"), F.lit("").alias("value"), images.cast("long").alias("n")),
    )
    facts = F.concat(rows("category", F.col("categories")), rows("brand", brand), whole)
    return products.select(F.explode(facts).alias("f")).select("f.*")


def stream_stats(stream: DataFrame, table: str, stats: str, checkpoint: str, order: list, buckets: int | None = None, **options):
    """The same, with the catalogue's statistics kept up after every batch.

    Each value has a count of the records that hold it. A batch takes what its buckets held before
    and adds what they hold now, so records that it left alone cancel out without a join; values
    whose count leaves or reaches 0 change the number of distinct ones. Neither the catalogue nor
    the counts are read but for the touched buckets, and the batch itself is not read again.
    ``stats`` has a version a batch, ``<stats>/references`` the counts.
    """
    references = f"{stats}/references"

    def on_batch(change, urls, batch_id):
        spark = change.after.sparkSession
        moved = _references(change.before, -1).unionByName(_references(change.after, 1))
        moved = moved.groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")

        def merge(before, arrived):
            rows = arrived if before is None else before.unionByName(arrived)
            return rows.groupBy("kind", "value").agg(F.sum("n").alias("n")).where("n <> 0")

        found = merge_buckets(moved, references, checkpoint, batch_id, ["kind", "value"], merge, buckets)
        touched = found.before.withColumn("sign", F.lit(-1)).unionByName(found.after.withColumn("sign", F.lit(1)))

        def gained(kind, amount):
            return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("sign") * amount)), F.lit(0)).cast("long")

        gains = touched.agg(
            gained("products", F.col("n")).alias("total_products"), gained("category", F.lit(1)).alias("total_categories"),
            gained("brand", F.lit(1)).alias("total_brands"), gained("images", F.col("n")).alias("total_images"),
        )
        prior, version = _state(spark, stats, checkpoint, batch_id)
        rows = gains if prior is None else prior.unionByName(gains)
        publish(rows.agg(*[F.sum(c).alias(c) for c in gains.columns]), stats, version)

    return upsert_latest(stream, table, checkpoint, order, on_batch, buckets, **options)


def stream_progress(stream: DataFrame, target: str, checkpoint: str, total: int, interval: str = "1 second",
                    available_now: bool = True):
    """Running ``(current, total, eta)`` from ``stream(ts)``; the last batch is always written."""

    def step(batch, batch_id):
        spark = batch.sparkSession
        seconds = F.col("ts").cast("timestamp").cast("double")
        seen = batch.agg(
            F.count(F.lit(1)).alias("current"), F.min(seconds).alias("started"), F.max(seconds).alias("now")
        )
        prior, version = _state(spark, target, checkpoint, batch_id)
        if prior is not None:
            seen = prior.select("current", "started", "now").unionByName(seen)
        state = seen.agg(
            F.sum("current").alias("current"), F.min("started").alias("started"), F.max("now").alias("now")
        )
        elapsed = F.col("now") - F.col("started")
        eta = F.round((F.lit(total) - F.col("current")) * elapsed / F.col("current"), 2)
        state = state.withColumn("total", F.lit(total).cast("long")).withColumn(
            "eta", F.when(F.col("current") > 0, eta).otherwise(0.0)
        )
        publish(state, target, version)

    return run_batches(stream, checkpoint, step, available_now, interval)


def stream_host_blocks(stream: DataFrame, table: str, checkpoint: str, order: list, buckets: int | None = None, **options):
    """Blocked failures per host since its last success, from ``stream(host, outcome, profile, ...)``.

    ``<table>/attempts`` keeps each blocked attempt after a host's last success, one row each, so
    attempts and successes may arrive in any order: a late success clears what lies before it and
    no more. ``table`` has a row a host. A batch reads and rewrites the buckets of its hosts.
    """
    attempts = f"{table}/attempts"

    def step(batch, batch_id):
        place = F.struct(*order)
        ok = F.col("outcome") == "ok"
        rows = batch.select(
            "host", F.when(F.col("outcome") == "fingerprint", place).alias("at"), F.when(ok, place).alias("won"),
            F.when(ok, F.col("profile")).alias("profile"), ok.alias("ok"))
        wins = rows.groupBy("host").agg(F.max("won").alias("won"), F.max_by("profile", "won").alias("profile"))
        arrived = wins.select("host", F.lit(None).cast(rows.schema["at"].dataType).alias("at"), "won", "profile").unionByName(
            rows.where("at is not null").select("host", "at", F.lit(None).cast(rows.schema["won"].dataType).alias("won"), F.lit(None).cast("string").alias("profile")))

        def merge(before, arrived):
            rows = arrived if before is None else before.unionByName(arrived)
            hosts = rows.where("at is null").groupBy("host").agg(F.max("won").alias("won"), F.max_by("profile", "won").alias("profile"))
            last = hosts.select(F.col("host").alias("_host"), F.col("won").alias("_won"))
            since = rows.where("at is not null").join(last, F.col("host").eqNullSafe(F.col("_host")), "left")
            since = since.where(F.col("_won").isNull() | (F.col("at") > F.col("_won"))).select("host", "at", "won", "profile")
            return hosts.select("host", F.lit(None).cast(rows.schema["at"].dataType).alias("at"), "won", "profile").unionByName(since)

        change = merge_buckets(arrived, attempts, checkpoint, batch_id, ["host"], merge, buckets)
        blocked = F.count("at")
        counted = change.after.groupBy("host").agg(
            blocked.alias("blocked"), (blocked >= EXHAUSTED_AFTER).alias("exhausted"), F.max("profile").alias("profile"), F.max("won").alias("won"))
        # the touched buckets are counted whole, so their rows replace those before
        merge_buckets(counted, table, checkpoint, batch_id, ["host"], lambda before, arrived: arrived, change.buckets)

    return run_batches(stream, checkpoint, step, **options)


def stream_price_context(stream: DataFrame, table: str, checkpoint: str, order: list,
                         limit: int = PROBE_LIMIT, **options):
    """First winning parameter and misses per host, from ``stream(host, url, param, priced, ...)``.

    A miss is a product no parameter priced so far. What is known of each product is kept in
    ``<table>/products``, so its observations may come in several batches and in any order.
    """

    def step(batch, batch_id):
        spark = batch.sparkSession
        place = F.struct(*order)
        won = F.col("priced") & F.col("param").isNotNull()
        product = batch.groupBy("host", "url").agg(
            F.min_by(F.when(won, F.col("param")), F.when(won, place)).alias("param"),
            F.min(F.when(won, place)).alias("at"),
            F.bool_or(F.col("priced") & F.col("param").isNull()).alias("plain"),
        )
        products = f"{table}/products"
        prior, version = _state(spark, products, checkpoint, batch_id)
        if prior is not None:
            product = prior.unionByName(product).groupBy("host", "url").agg(
                F.min_by("param", "at").alias("param"), F.min("at").alias("at"), F.bool_or("plain").alias("plain")
            )
        publish(product, products, version)
        state = read_published(spark, products).groupBy("host").agg(
            F.min("at").alias("won_at"), F.min_by("param", "at").alias("preferred_param"),
            F.bool_or("plain").alias("plain"),
            F.count_if(F.col("param").isNull() & ~F.col("plain")).alias("misses"),
        ).withColumn(
            "state",
            F.when(F.col("preferred_param").isNotNull(), "known")
            .when(F.col("plain") | (F.col("misses") >= limit), "settled")
            .otherwise("probing"),
        )
        publish(state, table, version)

    return run_batches(stream, checkpoint, step, **options)


def stream_context_memo(stream: DataFrame, table: str, checkpoint: str, order: list, segment, limit: int = PROBE_LIMIT,
                        buckets: int | None = None, **options):
    """What each host's memo says, from ``stream(host, event, param, ...)`` in any order of arrival.

    ``<table>/events`` keeps the log by host and ``segment``, a whole number that grows with
    ``order`` and bounds what one late event makes anew; ``<table>/stretches`` keeps the folded
    stretches of each segment, and ``table`` a row a host. A batch composes the segments it touches
    again, and folds the hosts it touches from tables, not from their logs.
    """

    def step(batch, batch_id):
        columns = ["host", "event", "param", *order]
        arrived = batch.where(F.coalesce("host", F.lit("")) != "").select(*columns, segment.cast("long").alias("segment"))
        keys = ["host", "segment"]
        change = merge_buckets(
            arrived, f"{table}/events", checkpoint, batch_id, keys,
            lambda before, rows: rows if before is None else before.unionByName(rows), buckets)
        touched = arrived.select(*keys).distinct()
        again = change.after.join(touched, keys, "left_semi")
        made = stretches(again, order, limit, segment=F.col("segment"))

        def merge(before, rows):
            return rows if before is None else before.join(touched, keys, "left_anti").unionByName(rows)

        parts = merge_buckets(made, f"{table}/stretches", checkpoint, batch_id, ["host"], merge, buckets)
        hosts = told(folded(parts.after), limit)
        # the touched buckets are folded whole, so their rows replace those before
        merge_buckets(hosts, table, checkpoint, batch_id, ["host"], lambda before, rows: rows, parts.buckets)

    return run_batches(stream, checkpoint, step, **options)
