"""Whole-page extraction: pages are generated from cases that say which layers hold which value."""

import json
from itertools import combinations

import pytest

from shelfmark.operators.extract import parse_products

LAYERS = ["jsonld", "microdata", "meta"]
NAMES = {"jsonld": "Kettle from data", "microdata": "Kettle from items", "meta": "Kettle from meta"}
PRICES = {"jsonld": 31, "microdata": 47, "meta": 59}
WRITERS = {
    "jsonld": lambda n, p: "<script type='application/ld+json'>" + json.dumps({"@type": "Product", "name": n, "offers": {"price": p, "priceCurrency": "EUR"}}) + "</script>",
    "microdata": lambda n, p: f"<section itemscope itemtype='http://schema.org/Product'><b itemprop='name'>{n}</b><i itemprop='price' content='{p}'>?</i><i itemprop='priceCurrency' content='EUR'></i></section>",
    "meta": lambda n, p: f"<meta property='og:title' content='{n}'><meta property='product:price:amount' content='{p}'><meta property='product:price:currency' content='EUR'>",
}
CASES = [c for n in range(1, 4) for c in combinations(LAYERS, n)]


def data(value):
    return "<script type='application/ld+json'>" + (value if isinstance(value, str) else json.dumps(value)) + "</script>"


# Odd pages, and what a field of their record is; None stands for no record at all.
ODD = {
    "empty": ("", None),
    "absent": (None, None),
    "noise": ("\x07\x00 <<a <b= >>> </", ("title", "")),
    "title tag": ("<title>Blue jug - Corner shop</title>", ("title", "Blue jug")),
    "typed list": (data([{"@type": "WebSite"}, {"@type": ["Thing", "Product"], "sku": "q1"}]), ("sku", "q1")),
    "broken first": (data("{oops") + data({"@type": "Product", "sku": "q2"}), ("sku", "q2")),
    "trailing comma": (data('{"@type":"Product","sku":"q3",}'), ("sku", "q3")),
    "commented out": ("<!--" + data({"@type": "Product", "sku": "no"}) + "-->" + data({"@type": "Product", "sku": "q4"}), ("sku", "q4")),
    "wrong types": (data({"@type": "Product", "name": 0.5, "offers": [[]], "image": {}, "brand": 7}), ("price_value", None)),
    "low price": (data({"@type": "Product", "offers": {"@type": "AggregateOffer", "lowPrice": "12", "highPrice": "20", "priceCurrency": "EUR"}}), ("price_value", 12.0)),
    "sold out": (data({"@type": "Product", "name": "n", "offers": {"availability": "http://schema.org/OutOfStock"}}), ("in_stock", False)),
}


def address(kind, key):
    return f"https://{kind}.example.org/item/{key}"


@pytest.fixture(scope="module")
def records(spark):
    pages = [(address("case", "-".join(c)), "".join(WRITERS[layer](NAMES[layer], PRICES[layer]) for layer in reversed(c))) for c in CASES]
    pages += [(address("odd", k.replace(" ", "-")), html) for k, (html, _) in ODD.items()]
    return {r.url: r for r in parse_products(spark.createDataFrame(pages, "url string, html string")).collect()}


@pytest.mark.parametrize("case", CASES)
def test_first_layer_that_has_a_value_wins(records, case):
    r = records[address("case", "-".join(case))]
    assert r.title in [NAMES[layer] for layer in case] and r.price_value in [float(PRICES[layer]) for layer in case]
    if "jsonld" in case:
        assert r.title == NAMES["jsonld"] and r.price_value == 31.0
    assert r.currency == "EUR" and set(r.extracted_by) >= {"title", "price"}


@pytest.mark.parametrize("key", ODD)
def test_odd_pages(records, key):
    url, expected = address("odd", key.replace(" ", "-")), ODD[key][1]
    if expected is None:
        assert url not in records
    else:
        assert records[url][expected[0]] == expected[1]
