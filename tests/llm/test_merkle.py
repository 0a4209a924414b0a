"""The manifest against trees built and climbed one node at a time."""

import hashlib
import zlib

import pytest

from shelfmark.llm.merkle import merkle_manifest

SCHEMA = "tree string, doc_id long, text string, lang string, source string, n_chars long, pos long, way string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 8])) for i in range(0, len(below), 8)])
    return levels


def climb(levels, pos):
    """(left, right) siblings from a place to the root."""
    for below in levels[:-1]:
        run = below[pos // 8 * 8 : pos // 8 * 8 + 8]
        yield "".join(run[: pos % 8]), "".join(run[pos % 8 + 1 :])
        pos //= 8


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(*row), row))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in langs]
    whole = plain_tree([t[-1][0] for t in trees])
    out = []
    for i, k in enumerate(langs):
        for pos, (_, _, leaf, row) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h, proof = plain_leaf(row[0], text, *row[2:]), ""
            for left, right in [*climb(trees[i], pos), *climb(whole, i)]:
                h, proof = sha(left + h + right), proof + left + right
            root = whole[-1][0]
            out.append((row[0], leaf, trees[i][-1][0], root, sha(proof), h, h == root))
    return out


def rows_of(sizes):
    rows = []
    for lang, n in sizes.items():
        for i in range(n):
            k = len(rows)
            rows.append((k * 7 % 1009, f"Text {k} É\n{'A' if k % 2 else 'a'}" * (k % 3), lang, None if k % 5 else "s", k))
    return rows


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 8}, {"en": 70}, {None: 1, "de": 9, "en": 65, "é": 1, "": 3},
    {f"l{i}": 1 + i % 3 for i in range(20)} | {None: 10},
])
def test_manifest_of_trees(spark, sizes):
    rows = rows_of(sizes)
    rows += [rows[0], rows[0][:1] + ("other",) + rows[0][2:], (None, None, rows[0][2], None, None), (None, "X", rows[0][2], "", 1), (2000, "", rows[0][2], "", 0)]
    frame = spark.createDataFrame([("t", *r, 1, "w") for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in merkle_manifest(frame).collect()]
    assert sorted(found, key=str) == sorted(plain_manifest(rows), key=str)
    assert {r[6] for r in found if r[1] != r[1]} <= {True}


def test_empty_and_alone(spark):
    frame = spark.createDataFrame([("t", 3, "abc", "en", "s", 3, 0, "w")], SCHEMA)
    (row,) = merkle_manifest(frame).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("") and row.verified
    none = merkle_manifest(frame.limit(0))
    assert none.count() == 0 and none.dtypes == merkle_manifest(frame).dtypes


def test_a_very_long_text(spark):
    rows = [(3, "Ab " * 2_000_000, "en", "s", 6_000_000), (6, "x", "en", "s", 1)]
    frame = spark.createDataFrame([("t", *r, 0, "w") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in merkle_manifest(frame).collect()), key=str) == sorted(plain_manifest(rows), key=str)
