"""Rule tables of a user: order, what is refused, empty tables."""

import pytest

from shelfmark.operators.extract import parse_products
from shelfmark.operators.rules import PLATFORM_RULES, SELECTORS, platform_rules_of, selectors_of

FIELDS = "field string, rank int, selector string"
PLATFORMS = "rank int, platform string, name string, supported boolean, pattern string, evidence string"


def test_selectors_come_first_and_count_once(spark):
    rules = spark.createDataFrame([("sku", 2, ".b"), ("sku", 1, '.a [data-x="p q"]'), ("sku", 2, ".b"), ("sku", 3, ".sku")], FIELDS)
    own = selectors_of(rules)
    assert own["sku"] == ['.a [data-x="p q"]', ".b", ".sku", *[s for s in SELECTORS["sku"] if s != ".sku"]]
    assert {f: own[f] for f in own if f != "sku"} == {f: SELECTORS[f] for f in SELECTORS if f != "sku"}
    assert selectors_of(rules.limit(0)) == SELECTORS


def test_selectors_are_used_by_the_parser(spark):
    pages = spark.createDataFrame([("u", "<h1 class='product_title'>Cup</h1><i class='sku'>old</i><p class='ref'>new</p>")], "url string, html string")
    own = selectors_of(spark.createDataFrame([("sku", 0, "p.ref")], FIELDS))
    assert [r.sku for r in parse_products(pages, own).collect()] == ["new"]
    assert [r.sku for r in parse_products(pages).collect()] == ["old"]


@pytest.mark.parametrize("row", [("colour", 0, ".x"), ("sku", 0, ""), ("sku", None, ".x"), ("sku", 0, ".a > .b"), ("sku", 0, "p:first-child"), (None, 0, ".x")])
def test_selectors_that_cannot_be_used_are_refused(spark, row):
    with pytest.raises(ValueError):
        selectors_of(spark.createDataFrame([row], FIELDS))


def test_platforms_replace_and_come_first(spark):
    rules = spark.createDataFrame([(5, "wix", "Wix", True, "b", "two"), (1, "wix", "Wix", True, "a", "one"), (2, "mine", "Mine", False, "m", "three")], PLATFORMS)
    own = platform_rules_of(rules)
    assert own[:2] == [("wix", "Wix", True, [("a", "one"), ("b", "two")]), ("mine", "Mine", False, [("m", "three")])]
    assert own[2:] == [r for r in PLATFORM_RULES if r[0] != "wix"]
    assert platform_rules_of(rules.limit(0)) == PLATFORM_RULES


@pytest.mark.parametrize("rows", [[(0, "x", "X", True, "(", "e")], [(0, "x", "X", None, "a", "e")], [(0, "x", "X", True, "a", "e"), (0, "x", "Y", True, "b", "e")]])
def test_platforms_that_cannot_be_used_are_refused(spark, rows):
    with pytest.raises(ValueError):
        platform_rules_of(spark.createDataFrame(rows, PLATFORMS))
