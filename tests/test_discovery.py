import json
import time

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import discovery as D
from shelfmark.operators import jsonld as J
from shelfmark.operators.elements import _read, _Vocabulary
from shelfmark.operators.extract import parse_products
from shelfmark.operators.rules import SELECTORS


def locations(spark, xml):
    return spark.createDataFrame([(xml,)], "xml string").select(D.sitemap_locations(F.col("xml")).alias("l")).first().l


@pytest.mark.parametrize("text, url", [
    ("a&#38;b", "a&b"), ("a&#x26;lt;b", "a&lt;b"), ("&#128512;&amp;&#0;&#xD800;", "\U0001F600&&#0;&#xD800;"),
    ("<![CDATA[ a&amp;b ]]>", "a&amp;b"), ("a & b", "a & b"),
])
def test_references_in_locations_are_decoded_once(spark, text, url):
    assert locations(spark, f"<urlset><url><loc> {text} </loc></url></urlset>") == [url]


def test_only_unprefixed_locations_are_pages(spark):
    assert locations(spark, "<url><loc>a</loc><image:image><image:loc>b</image:loc></image:image></url><LOC x='1'>c</LOC>") == ["a", "c"]
    assert locations(spark, None) == [] and locations(spark, "") == []


def test_the_root_element_tells_an_index(spark):
    long = "<!-- " + "urlset " * 5000 + "-->"
    rows = [(long + "<sitemapindex>",), ("<?xml version='1.0'?><s:SitemapIndex>",), ("<urlset><!-- <sitemapindex> --></urlset>",), (None,)]
    found = spark.createDataFrame(rows, "xml string").select(D.is_sitemap_index(F.col("xml")).alias("x")).collect()
    assert [r.x for r in found] == [True, True, False, False]


def test_more_sitemaps_than_any_old_limit(spark):
    index = "<sitemapindex>" + "".join(f"<loc>m{k}</loc>" for k in range(90)) + "</sitemapindex>"
    documents = spark.createDataFrame([("s", "top", index)] + [("s", f"m{k}", "<loc>p</loc>") for k in range(89)], "site string, sitemap_url string, xml string")
    seeds = spark.createDataFrame([("s", "top", 0)], "site string, sitemap_url string, pos int")
    seen = {r.sitemap_url: (r.visit, r.found) for r in D.expand_sitemap_index(documents, seeds).collect()}
    assert seen == {"top": (0, True), **{f"m{k}": (k + 1, k < 89) for k in range(90)}}
    few = D.expand_sitemap_index(documents, seeds, limit=5).collect()
    assert sorted(r.visit for r in few) == [0, 1, 2, 3, 4]


def test_a_crawl_visits_every_page(spark):
    base = "https://s.example"
    links = [("s", f"{base}/", k, f"{base}/list{k}") for k in range(200)] + [("s", f"{base}/list{k}", 0, f"{base}/product/{k}") for k in range(200)]
    seeds = spark.createDataFrame([("s", f"{base}/", 0)], "site string, url string, pos int")
    edges = spark.createDataFrame(links, "site string, page_url string, pos int, href string")
    assert D.crawl_link_graph(edges, seeds).count() == 200
    assert D.crawl_link_graph(edges, seeds, limit=11).count() == 10


def test_structured_data_at_any_depth_and_of_any_number(spark):
    deep = {"@type": "Product", "sku": "low"}
    for _ in range(40):
        deep = {"mainEntity": deep}
    wide = {"@graph": [{"@type": "Thing", "n": k} for k in range(300)] + [[{"@type": "Thing", "n": 300}]]}
    rows = [([json.dumps(deep)],), ([json.dumps(wide)],), (["[]", "{oops", ""],), ([],)]
    nodes = spark.createDataFrame(rows, "p array<string>").select(F.transform(J.jsonld_nodes(F.col("p")), lambda n: F.to_json(n)).alias("n")).collect()
    assert len(nodes[0].n) == 41 and json.loads(nodes[0].n[-1]) == {"@type": "Product", "sku": "low"}
    assert [json.loads(n).get("n") for n in nodes[1].n] == [None, *range(300, -1, -1)]  # lists are visited last to first
    assert [r.n for r in nodes[2:]] == [[], []]


def test_own_rules_for_titles_and_galleries(spark):
    own = {**SELECTORS, "title": ["h2.ware", *SELECTORS["title"]], "gallery": [".frames img", *SELECTORS["gallery"]]}
    html = "<h2 class=ware>Own</h2><h1 class=product_title>Usual</h1><div class=product-gallery><img src=/usual.jpg></div><p class=frames><img src=/own.jpg><img src=/own2.jpg></p>"
    pages = spark.createDataFrame([("https://s.example/p", html)], "url string, html string")
    usual, changed = parse_products(pages).first(), parse_products(pages, own).first()
    assert (usual.title, usual.images, usual.extracted_by["images"]) == ("Usual", ["https://s.example/usual.jpg"], "css:.product-gallery img")
    assert (changed.title, changed.images[0], changed.extracted_by["images"]) == ("Own", "https://s.example/own.jpg", "css:.frames img")


def test_time_grows_with_nesting_and_not_with_its_square():
    words, times = _Vocabulary(SELECTORS, False), []
    for n in (2_000, 20_000):
        start = time.process_time()
        assert _read(words, "<div class='summary'>" * n + "<p class=price>3</p>")[-1]["texts"] == ["3"]
        times.append(time.process_time() - start)
    assert times[1] < 40 * max(times[0], 0.01)


def test_prefixes_of_locations(spark):
    own = 'xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"'
    picture = 'xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'
    docs = {
        f"<?xml version='1.0'?><!-- <sm:x> --><sm:urlset {own} {picture}><sm:url><sm:loc>a</sm:loc><image:image><image:loc>p</image:loc></image:image></sm:url></sm:urlset>": ["a"],
        f"<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9' {own}><loc>a</loc><sm:loc> b </sm:loc></urlset>": ["a", "b"],
        f"<sm:urlset xmlns='urn:other' {own}><loc>n</loc><sm:loc>b</sm:loc></sm:urlset>": ["b"],
        "<urlset><loc>a</loc><image:loc>p</image:loc></urlset>": ["a"],
        "<s:urlset><s:loc>a</s:loc><loc>b</loc><t:loc>c</t:loc></s:urlset>": ["a", "b"],
        f"<urlset {own}><sm:loc>n</sm:loc><loc><![CDATA[x&y]]></loc></urlset>": ["x&y"],
        "<loc>bare</loc>": ["bare"], "": [], "garbage": [],
    }
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, xml string")
    found = {r.i: r.found for r in frame.select("i", D.sitemap_locations(F.col("xml")).alias("found")).collect()}
    assert [found[i] for i in range(len(docs))] == list(docs.values())
