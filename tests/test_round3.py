"""What one task, one file or one line costs: sizes that must not follow the table's."""

import gzip
import hashlib
import time

import pandas as pd
from pyspark.sql import functions as F

from shelfmark.operators import elements as E
from shelfmark.operators.exports import append_product_log
from shelfmark.operators.files import resolve_images
from shelfmark.operators.images import dedupe_image_variants
from shelfmark.plans import log_queries as Q
from shelfmark.plans import QUERIES
from shelfmark.runtime import shares
from shelfmark.schema import PRODUCT_SCHEMA
from shelfmark.sources import crawl as C
from shelfmark.sources.logs import parse_product_lines


def test_logs_are_written_compressed(spark, tmp_path):
    Q._write_lines(spark.createDataFrame([("a", "s")], "value string, site string"), f"{tmp_path}/log", "site")
    append_product_log(spark.createDataFrame([("a",)], "title string").coalesce(1), f"{tmp_path}/appended")
    assert len(list(tmp_path.glob("log/site=s/*.txt.gz"))) == 1 and len(list(tmp_path.glob("appended/*.json.gz"))) == 1
    assert spark.read.text(f"{tmp_path}/appended").first().value == '{"title":"a"}'


def test_a_snapshot_computes_its_products_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    plain = (*["x"] * 4, ["c"], ["i"], "", "", 1.0, "USD", "s", "", True, {})
    by = {"categories": ["c"], "images": ["i"], "price_value": 1.0, "in_stock": True, "extracted_by": {}}
    assert len(plain) == len(PRODUCT_SCHEMA.names)
    rows = spark.sparkContext.parallelize([tuple(by.get(n, "x") for n in PRODUCT_SCHEMA.names)], 1).map(counted)
    made = spark.createDataFrame(rows, PRODUCT_SCHEMA).withColumn("position", F.lit(1))
    monkeypatch.setattr(Q, "latest", lambda *_: made)
    assert {r.part: r.n for r in Q.write_snapshot(spark, "").collect()} == {"products": 1, "categories": 1, "failures": 0}
    assert seen.value == 1


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([('{"url": "u", "title": 7}',), ("{",), ("[1]",), ('{"x": 1}',)], "value string")
    read = parse_product_lines(lines)
    assert sorted((r.url, r.title) for r in read.collect()) == [("", ""), ("u", "7")]
    filters = [x for x in read._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("parseJson" in x or "parse_json" in x for x in filters)


def test_many_pictures_of_one_product(spark):
    few = ["/b-20x30.jpg", "/a.jpg", "/b-5x5.jpg", None, "/a-9x9.jpg", "", "/c.jpg", "/b-30x20.jpg", "/c.jpg"]
    many = [f"/i/{i}.jpg" for i in range(20000)]
    df = spark.createDataFrame([(0, few), (1, many), (2, []), (3, None)], "k int, v array<string>").coalesce(1)
    start = time.time()
    found = {r.k: r.x for r in df.select("k", dedupe_image_variants(F.col("v")).alias("x")).collect()}
    assert found == {0: ["/b-20x30.jpg", "/a.jpg", "/c.jpg"], 1: many, 2: [], 3: None}
    assert time.time() - start < 20


def test_elements_come_back_a_few_pages_at_a_time(spark):
    words = E._Vocabulary(E.SELECTORS, False)
    n = 3 * E.PAGES_AT_ONCE + 1
    parts = list(E._read_batches(words, iter([pd.Series(["<h1>x</h1>"] * n), pd.Series([], dtype=object)])))
    assert [len(p) for p in parts] == [E.PAGES_AT_ONCE] * 3 + [1]
    pages = spark.range(n).coalesce(1).select("id", F.concat(F.lit("<h1>"), F.col("id").cast("string"), F.lit("</h1>")).alias("html"))
    found = pages.select("id", E.element_array(F.col("html"))[0]["texts"][0].alias("t")).collect()
    assert len(found) == n and all(r.t == str(r.id) for r in found)


def test_large_scans_get_partitions_by_their_size(spark, tmp_path):
    spark.range(4000).repartition(8).write.parquet(f"{tmp_path}/many")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        many = spark.read.parquet(f"{tmp_path}/many")
        assert shares(many) == 16 * many.rdd.getNumPartitions() == 128
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.range(1).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert shares(spark.read.parquet(f"{tmp_path}/one")) is None


def test_an_archive_has_a_file_and_no_folder_for_each_page(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", f"<p>é{i}\r\n</p>\n") for i in range(40)] + [(50, "empty", ""), (51, "none", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr("shelfmark.plans.page_queries.scratch_path", lambda *_: f"{tmp_path}/archive")
    found = {r.url: r.chars for r in QUERIES["read_page_archive"](spark, str(tmp_path)).collect()}
    assert found == {url: len(html or "") for _, url, html in rows}
    name = {url: hashlib.sha1(url.encode()).hexdigest() + ".html.gz" for _, url, _ in rows}
    assert sorted(f.name for f in (tmp_path / "archive").iterdir()) == sorted(name.values())
    assert gzip.open(tmp_path / "archive" / name["u7"]).read().decode() == rows[7][2]
    # a page fetched again replaces its file; corrupt and missing ones are misses
    assert C.write_page_archive(spark.createDataFrame([("u1", "new")], "url string, html string"), f"{tmp_path}/archive") == 1
    whole = (tmp_path / "archive" / name["u2"]).read_bytes()
    (tmp_path / "archive" / name["u2"]).write_bytes(whole[: len(whole) // 2])
    asked = spark.createDataFrame([("u1",), ("u2",), ("u3",), ("gone",)], "url string")
    assert {r.url: r.html for r in C.read_page_archive(spark, f"{tmp_path}/archive", asked).collect()} == {"u1": "new", "u3": rows[3][2]}
    none = C.write_page_archive(spark.createDataFrame([], "url string, html string"), f"{tmp_path}/nothing")
    assert none == 0 and C.read_page_archive(spark, f"{tmp_path}/nothing", asked).count() == 0


def test_images_are_resolved_from_listings_read_once(spark):
    context = spark.sparkContext
    seen = {name: context.accumulator(0) for name in ("wanted", "files", "index")}

    def counted(name, rows, schema):
        count = seen[name]

        def add(row):
            count.add(1)
            return row

        return spark.createDataFrame(context.parallelize(rows, 1).map(add), schema)

    wanted = [("s", f"u{i}", f"T{i}", ["C"], f"https://s.test/{n}") for i, n in enumerate(["a.jpg", "b.jpg", "c.jpg", "d.jpg", "e.jpg"])]
    files = [("s", p) for p in ("r/C/T0/images/a.jpg", "r/C/T1/images/b_1.jpg", "old/images/c.jpg", "x/T3/images/d.jpg")]
    got = resolve_images(
        counted("wanted", wanted, "site string, url string, title string, categories array<string>, src string"),
        counted("files", files, "site string, path string"), counted("index", [("s", "u2", "old")], "site string, url string, folder string"), F.lit("r"))
    found = [(r.url, r.path, r.how) for r in got.collect()]
    paths = [p for _, p in files] + [""]
    assert sorted(found) == sorted([(f"u{i}", p, h) for i, (p, h) in enumerate(zip(paths, ["exact", "near", "exact", "legacy", "missing"]))])
    # what is wanted is read for its folders and for the result
    assert {k: v.value for k, v in seen.items()} == {"wanted": 10, "files": 4, "index": 1}
