"""Logs, snapshots, exports, and the keyed operators under a key that holds most of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import catalogue as C
from shelfmark.operators import discovery as D
from shelfmark.operators import exports as X
from shelfmark.operators import files as FI
from shelfmark.operators import quality as Q
from shelfmark.runtime import with_global_index
from shelfmark.schema import EXPORT_FIELDS, export_rows, normalize_records
from shelfmark.sources import logs as L

EXTRA = {"seq": "long"}
LINES = [
    '{"url":"u1","title":"A","categories":["x"],"price":12.5,"seq":1}', "", "  ", "not json", '["u9"]', "7",
    '{"url":"u2","title":"","categories":"solo","images":null,"seq":2}',
    ' {"url":"u1","title":"A2","brand":null,"price_value":5,"in_stock":true,"seq":3} ',
    '{"title":"no url","seq":4}', '{"title":"no url","seq":5}',
    '{"url":"u3","title":"é ü","categories":[],"price":true,"seq":6}', '{"url":"u4","tit',
]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log")
    (path / "part-0").write_text("\n".join(LINES), encoding="utf-8")
    return L.read_product_log(spark, str(path), EXTRA)


def test_log_skips_what_is_no_record(log):
    rows = {r.seq: r for r in log.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert rows[1].price == "12.5" and rows[1].brand == "Unknown" and rows[1].images == []
    assert rows[2].categories == ["solo"] and rows[3].in_stock is True and rows[3].price_value == 5.0
    assert rows[6].price == "True" and rows[6].title == "é ü"


def test_latest_keeps_first_place_and_url_less_records(log):
    rows = C.latest_per_url(log, ["seq"]).orderBy("position").collect()
    assert [(r.url, r.title) for r in rows] == [("u1", "A2"), ("u2", ""), ("u3", "é ü"), ("", "no url"), ("", "no url")]


def test_latest_does_not_depend_on_order_or_partitions(spark):
    rows = [(f"u{random.Random(i).randint(0, 9)}" if i % 3 else "hot", f"t{i}", i) for i in range(600)]
    want = {}
    for url, title, seq in rows:
        want[url] = title
    for parts, seed in ((1, 1), (7, 2)):
        mixed = rows[:]
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame(mixed, "url string, title string, seq long").repartition(parts)
        assert {r.url: r.title for r in C.latest_per_url(df, ["seq"]).collect()} == want


def test_normalising_twice_changes_nothing(log):
    once = normalize_records(log)
    assert sorted(map(str, once.collect())) == sorted(map(str, normalize_records(once).collect()))


def test_statistics(log):
    s = C.catalogue_stats(log).first()
    assert (s.total_products, s.total_categories, s.total_brands, s.total_images) == (6, 1, 0, 0)
    a = C.catalogue_stats(log, approximate=True).first()
    assert (a.total_products, a.total_categories) == (6, 1)


def test_search_and_pages(spark):
    df = spark.createDataFrame([(i, f"Item {i}", "", ["c"] if i % 2 else None) for i in range(30)],
                               "seq long, title string, short_description string, categories array<string>")
    assert C.search_products(df, "item 2").count() == 11
    assert C.search_products(df, "", "c").count() == 15
    assert [r.seq for r in C.paginate(df, 2, 7, ["seq"]).collect()] == list(range(7, 14))
    assert C.paginate(df, 9, 7, ["seq"]).count() == 0
    info = C.page_info(df, 5, 7).first()
    assert (info.total, info.total_pages, info.has_more) == (30, 5, False)
    assert [r.seq for r in C.log_tail(df, 3, ["seq"]).collect()] == [27, 28, 29]


def test_global_index_is_dense_under_a_hot_value(spark):
    df = spark.range(5000).select((F.when(F.col("id") < 4000, 7).otherwise(F.col("id"))).alias("k"), "id").repartition(6)
    got = with_global_index(df, ["k", "id"]).collect()
    want = {r.id: n for n, r in enumerate(sorted(got, key=lambda r: (r.k, r.id)))}
    assert {r.id: r["index"] for r in got} == want


def test_snapshot_missing_corrupt_and_good(spark, tmp_path):
    assert L.read_product_snapshot(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "bad.json").write_text('[{"url":"x",')
    assert L.read_product_snapshot(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "ok.json").write_text('[{"url":"a","title":"A"},\n{"url":"b","title":null}]')
    assert {r.url: r.title for r in L.read_product_snapshot(spark, str(tmp_path / "ok.json")).collect()} == {"a": "A", "b": ""}


def test_stores_under_a_root(spark, tmp_path):
    for name in ("a.test", "b.test", ".hidden"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "products.jsonl").write_text('{"url":"u","title":"t"}\n')
    assert sorted(r.site for r in L.scan_sites(spark, str(tmp_path)).collect()) == ["a.test", "b.test"]


def test_resume_uses_the_snapshot_for_an_empty_log(spark, tmp_path):
    (tmp_path / "products.jsonl").write_text("\n")
    (tmp_path / "products.json").write_text('[{"url":"a","title":"A"}]')
    assert L.load_products(spark, str(tmp_path)).count() == 0
    assert L.load_resume(spark, str(tmp_path)).count() == 1


RECORDS = [
    ("https://s.test/a", "Lamp & Shade", "HP", ["Light", "Lamps"], ["/a.jpg", "/b.jpg"], "<p>Fast &amp; light</p>", "<div>Specs <br> here</div>", 89500.0, True),
    ("https://s.test/b", "Old", None, None, None, None, None, None, None),
    ("u2", "", None, None, None, None, None, None, None),
]
SCHEMA = ("url string, title string, brand string, categories array<string>, images array<string>, "
          "short_description string, long_description string, price_value double, in_stock boolean")


def test_feeds_agree(spark, tmp_path):
    df = normalize_records(spark.createDataFrame(RECORDS, SCHEMA)).withColumn("site", F.lit("s.test"))
    rows = {r.url: r for r in export_rows(df).collect()}
    first = rows["https://s.test/a"]
    assert first.categories == "Light > Lamps" and first.images == "/a.jpg | /b.jpg"
    assert first.in_stock == "yes" and first.price_value == "89500.0" and rows["u2"].brand == "Unknown"
    X.export_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert back.columns == EXPORT_FIELDS and back.count() == 2
    X.export_xml(df, str(tmp_path / "xml"))
    xml = "".join(p.read_text() for p in (tmp_path / "xml").glob("part-*"))
    assert "<title>Lamp &amp; Shade</title>" in xml and "<sku></sku>" in xml.replace("<sku/>", "<sku></sku>")
    X.export_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_bundle_records_a_failing_format_and_goes_on(spark, tmp_path):
    df = normalize_records(spark.createDataFrame(RECORDS, SCHEMA)).withColumn("site", F.lit("s.test"))
    done = {r.format: r for r in X.export_bundle(df, str(tmp_path), formats=["json", "nope", "brands"]).collect()}
    assert done["json"].rows == 3 and done["json"].error is None
    assert "nope" in done["nope"].error and done["nope"].rows == 0 and done["brands"].rows == 1


def test_bundle_counts_what_the_files_hold(spark, tmp_path):
    rows = [("s", "A\nB", "u1", "<b>x</b>", ["c,1", 'c"2']), ("s", "", "u2", None, []), ("007", 'C "q", x', "u3", "l1\nl2", ["c,1"])]
    df = normalize_records(spark.createDataFrame(rows, "site string, title string, url string, long_description string, categories array<string>")).select("site", *EXPORT_FIELDS)

    def first_store(df, path, clean, partition):
        X.export_json(df.where("title <> '' AND site = 's'"), path, clean, partition)

    done = X.export_bundle(df, str(tmp_path), ["s", "007", "none"], [*X.FORMATS, "own"], writers={"own": first_store}).collect()
    got = {(r.site, r.format): (r.rows, r.error) for r in done}
    assert len(got) == len(done) == 21
    assert [got["s", f] for f in ("json", "csv", "excel", "xml", "categories", "own")] == [(2, None), (1, None), (1, None), (1, None), (2, None), (1, None)]
    assert [got["007", f] for f in ("json", "csv", "excel", "xml", "categories")] == [(1, None)] * 5
    assert got["007", "own"] == (0, "wrote 0 of 1 rows")
    assert all(got["none", f] == (0, None) for f in (*X.FORMATS, "own"))


def test_publishing_keeps_old_versions(spark, tmp_path):
    X.publish(spark.range(3), str(tmp_path), "001")
    X.publish(spark.range(5), str(tmp_path), "002")
    assert X.read_published(spark, str(tmp_path)).count() == 5
    assert X.read_published(spark, str(tmp_path / "none")) is None


def test_dominant_shape(spark):
    def infer(urls):
        df = spark.createDataFrame([("s", "x.test", u, i) for i, u in enumerate(urls)], "site string, host string, url string, pos int")
        return D.infer_product_urls(df).count()

    catalogue = [f"https://x.test/catalogue/item-{i}/" for i in range(40)]
    assert infer(catalogue + ["https://x.test/about", "https://x.test/contact-us"]) == 40
    assert infer([f"https://x.test/a/{i}" for i in range(10)] + [f"https://x.test/b/{i}" for i in range(10)]) == 0
    assert infer(catalogue[:3]) == 0
    assert infer([f"https://x.test/thing/{i}" for i in range(25)] + [f"https://x.test/item/{i}" for i in range(5)]) == 5


def test_sitemap_limit_counts_missing_documents(spark):
    index = "<sitemapindex>" + "".join(f"<loc>m{i}</loc>" for i in range(100)) + "</sitemapindex>"
    docs = spark.createDataFrame([("s", "root", index), ("s", "m5", "<urlset><loc>a</loc></urlset>")], "site string, sitemap_url string, xml string")
    seeds = spark.createDataFrame([("s", "root", 0)], "site string, sitemap_url string, pos int")
    assert D.expand_sitemap_index(docs, seeds).count() == 101
    got = {r.sitemap_url: r for r in D.expand_sitemap_index(docs, seeds, limit=61).collect()}
    assert len(got) == 61 and got["m5"].visit == 6 and got["m5"].found and not got["m6"].found


def test_crawl_budget_and_shape(spark):
    links = [("s", "https://x.test/", i, f"https://x.test/shop-{i}") for i in range(10)]
    links += [("s", f"https://x.test/shop-{i}", 0, f"https://x.test/product/{i}") for i in range(10)]
    links += [("t", "https://y.test/", i, f"https://y.test/thing/{i}") for i in range(30)]
    edges = spark.createDataFrame(links, "site string, page_url string, pos int, href string")
    seeds = spark.createDataFrame([("s", "https://x.test/", 0), ("t", "https://y.test/", 0)], "site string, url string, pos int")
    assert D.crawl_link_graph(edges, seeds).count() == 40
    few = D.crawl_link_graph(edges, seeds, limit=4).where("site = 's'")
    assert few.count() == 3


def test_host_blocks_match_a_sequential_count(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [
        ("hot" if rng.random() < 0.6 else f"h{rng.randint(0, 20)}", rng.choice(["ok", "fingerprint", "fingerprint", "transient"]),
         rng.choice(["a", "b"]), start + timedelta(seconds=i), i)
        for i in range(2000)
    ]
    count, good = {}, {}
    for host, outcome, profile, _, _ in rows:
        count.setdefault(host, 0)
        if outcome == "ok":
            count[host], good[host] = 0, profile
        elif outcome == "fingerprint":
            count[host] += 1
    df = spark.createDataFrame(rows, "host string, outcome string, profile string, ts timestamp, n int")
    got = Q.host_block_summary(df.repartition(5), ["n"]).collect()
    assert {r.host: r.blocked for r in got} == count
    assert {r.host: r.profile for r in got if r.profile} == good
    assert all(r.exhausted == (r.blocked >= 3) for r in got)


def test_responses(spark):
    rows = [(200, {"Content-Type": "text/html"}, "x" * 300, "ok"), (200, {"content-type": "text/html"}, "short", "transient"),
            (200, {"content-type": "application/json"}, "[]", "ok"), (200, {"CF-Mitigated": "challenge"}, "", "fingerprint"),
            (200, {}, "Just a Moment... " + "x" * 300, "fingerprint"), (200, {}, "", "transient"), (404, {}, "", "permanent"),
            (429, {}, "", "throttled"), (403, {}, "", "fingerprint"), (503, {}, "", "fingerprint"), (500, {}, "", "transient"),
            (None, {}, None, "transient")]
    df = spark.createDataFrame(rows, "status int, headers map<string,string>, body string, want string")
    assert all(r.want == r.outcome for r in Q.classify_response(df).collect())


def test_images_are_found_in_every_layout(spark):
    wanted = spark.createDataFrame(
        [("s", f"u{i}", t, ["C"], f"https://s.test/i/{n}") for i, (t, n) in enumerate(
            [("One", "a.jpg"), ("Two", "b.jpg"), ("Three", "c.jpg"), ("Four", "d.jpg"), ("Five", "e.jpg"), ("Six", "")])],
        "site string, url string, title string, categories array<string>, src string")
    files = [("s", "r/C/One/images/a.jpg", None), ("s", "r/C/Two/images/b_ab12cd.jpg", None), ("s", "old/f3/data.json", '{"url":"u2"}'),
             ("s", "old/f3/images/c.jpg", None), ("s", "img/images/Four/d.jpg", None), ("s", "x/Five/images/e.jpg", None)]
    tree = spark.createDataFrame(files, "site string, path string, content string")
    got = FI.resolve_images(wanted, tree.select("site", "path"), FI.product_folder_index(tree), F.lit("r")).collect()
    assert {r.url: (r.path, r.how) for r in got} == {
        "u0": ("r/C/One/images/a.jpg", "exact"), "u1": ("r/C/Two/images/b_ab12cd.jpg", "near"), "u2": ("old/f3/images/c.jpg", "exact"),
        "u3": ("img/images/Four/d.jpg", "legacy"), "u4": ("x/Five/images/e.jpg", "legacy"), "u5": ("", "missing")}


def test_similar_names_match_brute_force(spark):
    """One folder holds nearly all files, with names that begin alike."""
    rng = random.Random(3)
    long = "p" * 45

    def stem():
        return rng.choice(["a", "ab", "abc", long, long[:39] + "q", long + "z"]) + rng.choice(["", "x", "_1a2b3c", str(rng.randint(0, 5))])

    stored = sorted({f"r/C/T/images/{stem()}.jpg" for _ in range(60)})
    names = sorted({f"{stem()}.png" for _ in range(60)})
    wanted = spark.createDataFrame([("s", f"u{i}", "T", ["C"], f"https://s.test/{n}") for i, n in enumerate(names)],
                                   "site string, url string, title string, categories array<string>, src string")
    files = spark.createDataFrame([("s", p) for p in stored], "site string, path string")
    index = spark.createDataFrame([], "site string, url string, folder string")
    got = {r.url: r.path for r in FI.resolve_images(wanted, files, index, F.lit("r")).collect()}

    def alike(a, b):
        return b.startswith(a[:40]) or a.startswith(b[:40])

    for i, name in enumerate(names):
        matches = [p for p in stored if alike(name[:-4], p.split("/")[-1][:-4])]
        assert got[f"u{i}"] == (min(matches) if matches else ""), name


def test_lists_per_site_follow_the_plain_rule(spark, tmp_path):
    rows = [("s", b) for b in (" Acme ", "Acme", "Acme\t", " Unknown ", "Unknown", "", " ")] + [("t", "Zed")]
    X.export_distinct_list(spark.createDataFrame(rows, "site string, brand string"), str(tmp_path / "b"), "brand", "Brand Name", "site")
    read = spark.read.option("header", True).csv(str(tmp_path / "b"))
    assert sorted((r.site, r["Brand Name"]) for r in read.collect()) == [("s", "Acme"), ("s", "Unknown"), ("t", "Zed")]
