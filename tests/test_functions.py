"""Scalar helpers against literals, and against the standard library where it has the same rule."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import money, paths, text, urls
from shelfmark.operators.images import dedupe_image_variants


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1)
    return lambda c: base.select(c.alias("x")).first().x


def _pairs(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.x for r in df.select("v", fn(F.col("v")).alias("x")).collect()}


def test_numbers_in_text(spark):
    want = {
        "KSh 12,999.00": 12999.0, "4500": 4500.0, "1.234.567": 1234567.0, "": None, "Call for price": None,
        "12,99": 1299.0, "1.234,56": 1.23456, "a 1 000 b": 1000.0, "5": 5.0,
    }
    assert _pairs(spark, want, money.to_number) == want


def test_display_prices(spark):
    values = [12999.0, 19.99, 0.5, 1234567.891, 12.5, 0.125, 99.999, 1e16]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", money.format_price(F.col("v"), F.lit("kes")).alias("p"), text.float_text(F.col("v")).alias("t")).collect():
        amount = f"{r.v:,.2f}".rstrip("0").rstrip(".") if r.v % 1 else f"{r.v:,.0f}"
        assert r.p == f"KSh {amount}" and r.t == str(r.v)


def test_numbers_as_text(spark):
    values = [1e7, 1.5e16, 0.00012, 5e-05, 123456789.125, 0.001, -3.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.t == str(r.v) for r in df.select("v", text.float_text(F.col("v")).alias("t")).collect())


@pytest.mark.parametrize("base", ["https://x.test/a/b/c.html?q=1#f", "https://x.test", "https://x.test/a/"])
def test_resolving_matches_the_standard_rule(spark, base):
    refs = ["", "d", "/d", "../d", "../../../d", "./d", "?z=1", "//h.test/x", "http://o.test", "mailto:x@y",
            "d/../e/", "..", ".", "/a/../b", "d//e", "/a//b", "d?x=1#y"]
    got = _pairs(spark, refs, lambda c: urls.resolve_url(c, F.lit(base)))
    assert got == {r: urljoin(base, r) for r in refs}


def test_scrapable_pages(spark):
    want = {
        "https://api.x.test/media/1/photo.jpeg": False, "https://x.test/manual.pdf": False,
        "https://x.test/blog/hello": False, "https://x.test/cart": False, "https://x.test/shop/": False,
        "https://x.test/product/thing": True, "https://x.test/index.php/shop/": False,
        "https://x.test/index.php/": False, "https://x.test/": False, "https://x.test": False,
        "https://x.test/index.php/product/192/": True, "https://x.test/shopping-trolley/": True,
        "https://x.test/zh": False, "ftp://x.test/product/a": False, "": False,
    }
    assert _pairs(spark, want, urls.is_scrapable_page) == want
    other = _pairs(spark, ["https://cdn.other.test/product/x"], lambda c: urls.is_scrapable_page(c, F.lit("x.test")))
    assert list(other.values()) == [False]


def test_site_names(spark):
    want = {
        "https://www.Example.co.test/product/x": "example.co.test", "x.test/a": "x.test",
        "https://user:pw@x.test:80/": "x.test_80", "https://a b.test/": "a_b.test",
    }
    assert _pairs(spark, want, urls.site_name) == want


def test_parameters(one):
    params = F.create_map(F.lit("sid"), F.lit("NEW"))
    assert one(urls.with_params(F.lit("https://x.test/p/1?a=2"), params)) == "https://x.test/p/1?a=2&sid=NEW"
    assert one(urls.with_params(F.lit("https://x.test/p?sid=OLD"), params)) == "https://x.test/p?sid=NEW"
    assert one(urls.with_params(F.lit("https://x.test/p"), F.create_map(F.lit("k"), F.lit("a b~*")))) == "https://x.test/p?k=a+b~%2A"


def test_normalising(spark):
    got = _pairs(spark, ["https://a.test/products/intel®-core", "https://a.test/p/1?x=2", ""], urls.normalize_url)
    assert "%C2%AE" in got["https://a.test/products/intel®-core"]
    assert got["https://a.test/p/1?x=2"] == "https://a.test/p/1?x=2" and got[""] == ""


def test_descriptions(one):
    assert one(text.clean_html(F.lit("<p>Fast &amp; light</p><br>\n\n x"))) == "Fast & light\n x"
    assert one(text.html_to_text(F.lit("<p>a &lt;b&gt;</p><script>no</script>c"))) == "a <b>\nc"
    assert one(text.has_content(F.lit("<p>&nbsp;</p>"))) is False


def test_folder_names(one):
    long_a = F.lit("Oak Rocking Chair with a very long descriptive name in Black")
    long_b = F.lit("Oak Rocking Chair with a very long descriptive name in Blue")
    a, b = one(paths.safe_path_segment(long_a, 40)), one(paths.safe_path_segment(long_b, 40))
    assert a != b and len(a) <= 40 and len(b) <= 40
    assert one(paths.safe_path_segment(F.lit("CON"))) == "CON_" and one(paths.safe_path_segment(F.lit(""))) == "unnamed"
    assert one(paths.safe_path_segment(F.lit("a/b\\c:d*e?"))) == "a_b_c_d_e"


def test_path_budget(one):
    deep = F.array(*[F.lit("C" * 90)] * 6)
    folder = one(paths.product_dir(F.lit("data/s/structured"), deep, F.lit("T" * 300), F.lit("")))
    assert len(folder) + len("/images/") + paths.MIN_FILENAME <= paths.MAX_PATH
    none = F.array().cast("array<string>")
    assert one(paths.product_dir(F.lit("r"), none, F.lit("Thing"), F.lit(""))) == "r/Uncategorized/Thing"
    assert one(paths.image_path(F.lit("x" * 300), F.lit("https://x.test/a.jpg"))) == ""
    name = one(paths.safe_filename(F.lit("https://x.test/" + "y" * 200 + ".jpg")))
    assert len(name) == paths.MAX_FILENAME and name.endswith(".jpg")


def test_image_variants(one):
    def best(*images):
        return one(dedupe_image_variants(F.array(*[F.lit(i) for i in images])))

    assert best("/p-300x300.jpg", "/p.jpg", "/p-600x600.jpg") == ["/p.jpg"]
    assert best("/p-150x150.jpg", "/p-800x800.jpg", "/p-300x300.jpg") == ["/p-800x800.jpg"]
    assert best("/front.jpg", "/back.jpg") == ["/front.jpg", "/back.jpg"]
    assert best("/1920x1080-wallpaper.png") == ["/1920x1080-wallpaper.png"]
