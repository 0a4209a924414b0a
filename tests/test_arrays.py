"""Arrays of any layout against a JSON reader, with many splits a file."""

import json
import random

import pytest

from shelfmark.sources import crawl as SC
from shelfmark.sources import logs as L
from shelfmark.sources.arrays import read_json_array


def odd_value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choices(['"', "\\", "[", "]", "{", "}", ",", "a", "é", "\n", " ", '",', " "], k=rng.randrange(8)))
    if kind == 3:
        return rng.choice([None, True, 1.5, -2])
    if kind == 4:
        return rng.choice([[], {}, "", [[]]])
    if kind < 7:
        return {odd_value_key(rng): odd_value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [odd_value(rng, depth + 1) for _ in range(rng.randrange(4))]


def odd_value_key(rng):
    return rng.choice(["a", "b,", 'c"', "d}", "\\"])


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii", [True, False])
def test_elements_of_any_layout(spark, tmp_path, indent, ascii):
    rng = random.Random(indent or 7)
    files = [[odd_value(rng) for _ in range(n)] for n in (0, 1, 2, 40, 200)]
    for k, values in enumerate(files):
        (tmp_path / f"f{k}.json").write_text(rng.choice(["", " \n"]) + json.dumps(values, indent=indent, ensure_ascii=ascii) + rng.choice(["", "\n"]))
    for k, text in enumerate(["", "[", '[{"a": 1', "{}", '{"a": [1, 2]}', "null", '["a", "b', "1, 2", "[1], [2]"]):
        (tmp_path / f"bad{k}.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_json_array(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {}
    for r in sorted(rows, key=lambda r: (r.file, r.element)):
        found.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.value))
    assert found == {f"f{k}.json": values for k, values in enumerate(files) if values}


def test_lists_as_a_run_writes_them(spark, tmp_path):
    categories, failures = ["Tables, \"round\"", "Ünder [10]", "a"], [{"url": "u1", "reason": "HTTP 404, gone"}, {"url": "u2", "reason": None}]
    products = [{"url": f"u{k}", "title": f"T, {k}", "categories": ["x", "y"], "images": []} for k in range(30)]
    for indent in (None, 2):
        folder = tmp_path / str(indent)
        folder.mkdir()
        for name, value in (("categories", categories), ("failed", failures), ("products", products)):
            (folder / f"{name}.json").write_text(json.dumps(value, indent=indent, ensure_ascii=False))
        assert sorted(r.category for r in SC.read_categories(spark, str(folder / "categories.json")).collect()) == sorted(categories)
        assert sorted(tuple(r) for r in SC.read_failures(spark, str(folder / "failed.json")).collect()) == [("u1", "HTTP 404, gone"), ("u2", None)]
        read = L.read_product_snapshot(spark, str(folder / "products.json")).collect()
        assert sorted((r.url, r.title, tuple(r.categories)) for r in read) == sorted((p["url"], p["title"], ("x", "y")) for p in products)
