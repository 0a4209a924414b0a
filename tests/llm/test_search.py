"""Decontamination and embeddings against plain searches; the registered queries against SQL."""

import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from shelfmark.llm.decontaminate import decontaminate, longest_matches
from shelfmark.llm.hamming import embedding_near_dedup


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_decontamination(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for name, text in items:
            x = plain_words(text)
            n = min(10, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(name))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [16 << 20, 400])
def test_windows_of_items(spark, block):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abé9", k=rng.randrange(1, 3)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([0, 1, 2, 9, 10, 11, 30, 30])] + [(8, None), (9, "?!"), (10, "Zebra")]
    docs = [(1, None), (2, ""), (3, "ZEBRA-crossing"), (4, "zebra2")]
    for i in range(5, 40):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 20)))]
        name, text = rng.choice(items[3:8])
        x = text.split()
        s = rng.randrange(0, max(1, len(x) - 12))
        parts += [", ".join(x[s : s + rng.randrange(8, 25)]).upper().replace("É", "é"), word()]
        docs.append((i, "\n".join(parts)))
    frame = spark.createDataFrame([(i, t, 1, "q") for i, t in docs] + [(None, "zebra", 1, "q")], "doc_id long, text string, n_hit int, row string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(frame, tests, block_bytes=block).collect()
    key = lambda r: (r[0] is None, r[0])
    expected = plain_decontamination(docs + [(None, "zebra")], items)
    assert sorted((tuple(r) for r in found), key=key) == sorted(expected, key=key)
    assert decontaminate(frame.limit(0), tests).count() == 0
    assert not any(r.contaminated for r in decontaminate(frame, tests.limit(0)).collect())


def test_words_of_one_polynomial_hash(spark):
    bits = [0]
    for _ in range(10):
        bits += [1 - b for b in bits]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = [(1, one), (2, other), (3, f"{one} {other}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate(frame, spark.createDataFrame([("i", one), (None, other)], "item_id string, text string")).collect()
    empty, listed = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"i").hexdigest()
    assert sorted(tuple(r) for r in found) == [(1, 1, 1, 1, listed, True), (2, 1, 1, 0, empty, True), (3, 2, 2, 1, listed, True)]
    lone = decontaminate(frame, spark.createDataFrame([("i", one)], "item_id string, text string")).collect()
    assert {r.doc_id: r.n_hit for r in lone} == {1: 1, 2: 0, 3: 1}


def test_matches_that_only_touch_stay_apart(spark):
    w = [f"w{i}" for i in range(60)]
    text = " ".join(w[30:40] + w[10:20] + ["x"] + w[40:52])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = longest_matches(docs, spark.createDataFrame([("i", " ".join(w))], "item_id string, text string")).collect()
    assert (row.word, row.n_words) == (21, 12)


def test_longest_match_and_its_place(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x y " + text[:100] + " z"), (2, "nothing")], "doc_id long, text string")
    (row,) = longest_matches(docs, spark.createDataFrame([("i", text)], "item_id string, text string")).collect()
    whole = len(plain_words(text[:100])) - (text[100] not in " ")
    assert (row.doc_id, row.item_id, row.word, row.n_words) == (1, "i", 2, whole)


def plain_links(rows):
    ok = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = (x / np.linalg.norm(x), label)
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    pairs = [(i, j) for i in ok for j in ok if i < j and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] >= 0.98]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return links, root


@pytest.mark.parametrize("block", [2000, 7])
def test_links_of_embeddings(spark, block):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for _ in range(25):
        base = rng.normal(size=32)
        for _ in range(rng.integers(1, 9)):
            rows.append((i, (base + rng.normal(size=32) * rng.choice([0.01, 0.12])).astype(np.float32).tolist(), int(rng.integers(0, 2))))
            i += 1
    rows += [(i + k, rows[3][1], rows[3][2]) for k in range(4)]
    i += 4
    rows += [(i, None, 1), (i + 1, [0.0] * 32, 1), (i + 2, [None] * 32, 1), (i + 3, [float("nan")] * 32, 1), (i + 4, rows[3][1], None), (i + 5, [], 1), (i + 6, [1.0, 2.0], 1)]
    frame = spark.createDataFrame([(*r, "z", 9) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    found = {r.vec_id: r for r in embedding_near_dedup(frame, block=block).collect()}
    links, root = plain_links(rows)
    assert len(found) == len(rows)
    linked = sum(links.values())
    got = sum(r.n_links for r in found.values())
    assert 0.97 * linked <= got <= linked
    wrong = [i for i in root if found[i].component_id != root[i]]
    assert len(wrong) <= 0.03 * len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert all(found[k].n_links == 0 and found[k].component_id == k for k in range(i, i + 7))
    assert embedding_near_dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block, fit_values", [(2000, 8 << 20), (7, 8 << 20), (7, 1)])
def test_links_of_embeddings_of_several_lengths(spark, monkeypatch, block, fit_values):
    from shelfmark.llm import hamming

    monkeypatch.setattr(hamming, "FIT_VALUES", fit_values)
    rng, rows = np.random.default_rng(7), []
    for d, groups in [(32, 20), (24, 8), (48, 6), (16, 1), (1, 1)]:
        for _ in range(groups):
            base = rng.normal(size=d)
            for _ in range(2):
                rows.append((len(rows), (base + rng.normal(size=d) * 0.01).tolist(), 1))
    rows.append((len(rows), [1.0] * 5, 1))
    found = {r.vec_id: r for r in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block).collect()}
    links, root = plain_links(rows)
    assert len(found) == len(rows) and sum(links.values()) >= 70
    assert {i: (r.n_links, r.component_id) for i, r in found.items()} == {i: (links[i], root[i]) for i in root}


@pytest.mark.parametrize("shared", [0.0, 3.0])
def test_recall_at_the_threshold(spark, shared):
    """1,500 pairs between 0.98 and 0.985 among 3,000 classes; with ``shared`` all vectors lean to one direction."""
    rng, d = np.random.default_rng(8), 64
    lean = np.ones(d) * shared / np.sqrt(d)
    base = rng.normal(size=(1500, d)) / np.sqrt(d) + lean
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.985, size=(1500, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * aside])
    found = {r.vec_id: r for r in embedding_near_dedup(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    links = (x @ x.T >= 0.98).sum(1) - 1
    assert links.sum() >= 3000 and all(found[i].n_links <= links[i] for i in range(len(x)))
    recall = sum(r.n_links for r in found.values()) / links.sum()
    print("recall", recall)
    assert recall >= 0.98


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["op8_embedding_near_dedup", "op10_decontaminate"])
def test_query_agrees_with_sql(spark, name):
    from check import TABLES, compare
    from shelfmark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, found = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    assert compare(df.collect(), df.columns, found.fetchall(), [d[0] for d in found.description]) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in c.STAGES[:3]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == c.COLUMNS
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = c.run(spark, SF).collect()
    assert {r.doc_id for r in packed} <= ids
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "t", "en", None, 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], before.schema)
    for name, stage in c.STAGES:
        assert stage(spark, odd, SF).count() > 0, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
