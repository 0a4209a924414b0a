import random
import re

import numpy as np
import pytest
import xxhash

from shelfmark.llm.simhash import ball_links, fingerprint, simhash_near_dedup


def plain_fingerprint(text):
    """Shingle by shingle and bit by bit."""
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in zip(ids, fps):
        for j, y in zip(ids, fps):
            if i < j and (x ^ y).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_of_odd_texts():
    for t in [None, "", " \t\n", "One", "a b c", "A b C d É", "x " * 50, "é è ê ë\x1c f g", "w" * 5000]:
        assert fingerprint(t) == plain_fingerprint(t)


def test_components_agree_with_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefg", k=5)) for _ in range(300)]
    texts = [None, "", "  ", "One", "one"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 40, 400]))
        for _ in range(rng.choice([1, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    ids = list(range(100, 100 + len(texts)))
    rows = [(i, t, 7, "x", "y") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows + rows[5:8] + [(None, "null id", 7, "x", "y")], "doc_id long, text string, fp int, component_id string, node string")
    found = simhash_near_dedup(docs).collect()
    fps = {i: plain_fingerprint(t) for i, t in zip(ids, texts)}
    expected = plain_components(ids, [fps[i] for i in ids])
    assert len(found) == len(rows) + 4
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", expected[r.doc_id])


@pytest.mark.parametrize("limit", [4_000_000, 3000])
def test_links_of_a_dense_ball_and_split_cells(spark, limit):
    """Many fingerprints around one, so that cells overflow and are split: the same components."""
    from shelfmark.llm.components import components

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6).tolist()
    fps = {b ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 4), False)) for b in base for _ in range(25)}
    fps |= set(rng.integers(0, 1 << 63, 30).tolist())
    fps = sorted(fps)
    rows = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, node long")
    found = {r.node: r.component for r in components(ball_links(rows, cell_variants=limit)).collect()}
    expected = plain_components(list(range(len(fps))), fps)
    assert {i: found.get(i, i) for i in expected} == expected


def test_empty_table(spark):
    assert simhash_near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
