from pyspark.sql import functions as F

import os
import random

from shelfmark.operators.catalogue import catalogue_stats, latest_per_url
from shelfmark.operators.exports import read_published
from shelfmark.operators.quality import host_block_summary
from shelfmark.streaming import jobs as S
from shelfmark.streaming.buckets import manifest, merge_buckets, read_buckets


def test_a_fresh_checkpoint_adds_to_the_table(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "host string, outcome string, profile string, seq long"
    seen = 0
    for run, hosts in enumerate([["a", "b"], ["c", "a"]]):
        rows = [(h, "fingerprint", "p", seen + k) for k, h in enumerate(hosts)]
        seen += len(rows)
        spark.createDataFrame(rows, schema).write.parquet(f"{source}/{run}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/{run}")
        S.stream_host_blocks(stream, table, str(tmp_path / f"checkpoint{run}"), ["seq"])
    assert {r.host: r.blocked for r in read_buckets(spark, table).collect()} == {"a": 2, "b": 1, "c": 1}


def test_a_redone_batch_writes_the_same_version(spark, tmp_path):
    checkpoint, table = tmp_path / "checkpoint", str(tmp_path / "table")
    checkpoint.mkdir()
    (checkpoint / "metadata").write_text('{"id":"q"}')
    for _ in range(2):
        prior, version = S._state(spark, table, str(checkpoint), 0)
        assert prior is None
        S.publish(spark.range(2), table, version)
    prior, following = S._state(spark, table, str(checkpoint), 1)
    assert prior.count() == 2 and following > version
    assert read_published(spark, table).agg(F.count("*")).first()[0] == 2


def run_in_batches(spark, tmp_path, batches, schema, job, order):
    """Run ``job`` over one batch after another, each with a checkpoint of its own."""
    table = str(tmp_path / "table")
    for run, rows in enumerate(batches):
        source = str(tmp_path / f"in{run}")
        spark.createDataFrame(rows, schema).write.parquet(source)
        job(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / f"checkpoint{run}"), order)
    return {r.host: r for r in (read_buckets(spark, table) or read_published(spark, table)).collect()}


def test_a_late_attempt_before_the_last_success_does_not_count(spark, tmp_path):
    schema = "host string, outcome string, profile string, seq long"
    batches = [
        [("a", "fingerprint", "p", 1), ("a", "ok", "q", 5), ("a", "fingerprint", "p", 6), ("b", "fingerprint", "p", 7)],
        [("a", "fingerprint", "p", 3), ("a", "ok", "old", 2), ("a", "fingerprint", "p", 8), ("b", "ok", "r", 9)],
    ]
    found = run_in_batches(spark, tmp_path, batches, schema, S.stream_host_blocks, ["seq"])
    assert {h: (r.blocked, r.exhausted, r.profile) for h, r in found.items()} == {"a": (2, False, "q"), "b": (0, False, "r")}


def test_a_product_split_over_batches_is_one_product(spark, tmp_path):
    schema = "host string, url string, param string, priced boolean, seq long"
    batches = [
        [("a", "1", "x", False, 1), ("b", "1", "x", False, 2), ("b", "2", "x", True, 9)],
        [("a", "1", "y", False, 3), ("b", "1", "y", True, 4)],
    ]
    found = run_in_batches(spark, tmp_path, batches, schema, S.stream_price_context, ["seq"])
    assert {h: (r.preferred_param, r.misses, r.state) for h, r in found.items()} == {"a": (None, 1, "probing"), "b": ("y", 0, "known")}


def test_host_blocks_for_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(4)
    schema = "host string, outcome string, profile string, seq long"
    rows = [(rng.choice("abc"), rng.choice(["fingerprint", "fingerprint", "ok", "transient"]), f"p{k}", k) for k in range(60)]
    rows += [("d", "transient", "p", 61), (None, "fingerprint", "p", 62)]
    expected = {r.host: (r.blocked, r.exhausted, r.profile) for r in host_block_summary(spark.createDataFrame(rows, schema), ["seq"]).collect()}
    for turn in range(2):
        rng.shuffle(rows)
        batches = [rows[k::3] for k in range(3)]
        found = run_in_batches(spark, tmp_path / str(turn), batches, schema, S.stream_host_blocks, ["seq"])
        assert {h: (r.blocked, r.exhausted, r.profile) for h, r in found.items() if h} == {h: v for h, v in expected.items() if h}
        assert found[None].blocked == 1


PRODUCT = "url string, title string, brand string, categories array<string>, images array<string>, seq long"


def products(rng, first, n, urls):
    out = []
    for k in range(first, first + n):
        url = rng.choice([None, "", *urls])
        out.append((url, rng.choice(["", "t", "u"]), rng.choice([None, "", "Unknown", "A", "B", "C"]),
                    rng.choice([None, [], ["x"], ["x", "y"], ["z", None]]), rng.choice([None, [], ["i"], ["i", "j"]]), k))
    return out


def test_statistics_equal_the_recount_after_every_batch(spark, tmp_path):
    rng = random.Random(8)
    seen, table, stats = [], str(tmp_path / "table"), str(tmp_path / "stats")
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for run in range(3):
        rows = products(rng, 100 * run, 25, [f"u{i}" for i in range(8)])
        seen += rows
        spark.createDataFrame(rows, PRODUCT).coalesce(1).write.mode("append").parquet(source)
        S.stream_stats(spark.readStream.schema(PRODUCT).parquet(source), table, stats, checkpoint, ["seq"], buckets=8)
        whole = latest_per_url(spark.createDataFrame(seen, PRODUCT), ["seq"])
        assert read_published(spark, stats).collect() == catalogue_stats(whole).collect()
        columns = ["url", "title", "brand", "seq"]
        assert sorted(read_buckets(spark, table).select(*columns).collect(), key=str) == sorted(whole.select(*columns).collect(), key=str)


def test_statistics_of_many_urls_need_no_broadcast_and_one_reading(spark, tmp_path):
    rows = spark.range(6000).select(
        F.concat(F.lit("https://a.example/product/"), (F.col("id") % 4000).cast("string")).alias("url"), F.lit("t").alias("title"),
        F.concat(F.lit("B"), (F.col("id") % 7).cast("string")).alias("brand"), F.array(F.lit("x")).alias("categories"),
        F.array(F.lit("i"), F.lit("j")).alias("images"), F.col("id").alias("seq"))
    source, table, stats = (str(tmp_path / name) for name in ("in", "table", "stats"))
    seen = spark.sparkContext.accumulator(0)
    noted = F.udf(lambda title: seen.add(1) or title)
    # the planner takes a batch of compressed lines for small, so what is left to it to broadcast may be of any size
    spark.conf.set("spark.sql.maxBroadcastTableSize", "32KB")
    try:
        for part in range(2):
            rows.where(F.col("seq") % 2 == part).write.mode("append").parquet(source)
            stream = spark.readStream.schema(rows.schema).parquet(source).withColumn("title", noted("title"))
            S.stream_stats(stream, table, stats, str(tmp_path / "checkpoint"), ["seq"], buckets=4)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert seen.value == 6000
    assert read_published(spark, stats).collect() == catalogue_stats(latest_per_url(rows, ["seq"])).collect()


def summed(before, arrived):
    rows = arrived if before is None else before.unionByName(arrived)
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    checkpoint, table = tmp_path / "checkpoint", str(tmp_path / "table")
    checkpoint.mkdir()
    (checkpoint / "metadata").write_text('{"id":"q"}')
    many = spark.range(2000).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
    first = merge_buckets(many, table, str(checkpoint), 0, ["key"], summed, 16)
    one = many.where("key = 7")
    for _ in range(2):  # a batch that is redone changes nothing
        second = merge_buckets(one, table, str(checkpoint), 1, ["key"], summed)
        assert second.version > first.version and second.buckets == 16
        held = manifest(spark, table)
        assert len([f for f in held.folders.values() if second.version in f]) == 1 and len(held.folders) == 16
        assert {r.key: r.n for r in read_buckets(spark, table).collect()} == {k: 1 + (k == 7) for k in range(2000)}
    merge_buckets(one, table, str(checkpoint), 2, ["key"], summed)
    named = set(manifest(spark, table).folders.values())
    stored = {f"data/{v}/{b}" for v in os.listdir(f"{table}/data") for b in os.listdir(f"{table}/data/{v}") if b.startswith("_bucket=")}
    assert named < stored and len(stored - named) == 1  # what the version before still names
    # another query adds to the table; rows that go leave an empty bucket behind
    (checkpoint / "metadata").write_text('{"id":"r"}')
    merge_buckets(one, table, str(checkpoint), 0, ["key"], lambda before, arrived: before.join(arrived.select("key"), "key", "left_anti"))
    assert read_buckets(spark, table).count() == 1999


def test_a_batch_is_kept_in_files_while_it_is_merged(spark, tmp_path):
    checkpoint, table, kept = tmp_path / "checkpoint", str(tmp_path / "table"), []
    checkpoint.mkdir()
    (checkpoint / "metadata").write_text('{"id":"q"}')

    def merge(before, arrived):
        kept.append((arrived.storageLevel.useMemory, len(arrived.inputFiles()) > 0))
        return summed(before, arrived)

    many = spark.range(20).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
    for batch in range(2):
        version = merge_buckets(many, table, str(checkpoint), batch, ["key"], merge, 4).version
    assert kept == [(False, True)] * 2
    assert version in os.listdir(f"{table}/data") and not [f for f in os.listdir(f"{table}/data") if f.startswith("arrived")]
    assert {r.n for r in read_buckets(spark, table).collect()} == {2}
