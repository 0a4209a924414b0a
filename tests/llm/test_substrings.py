import hashlib
import random

import numpy as np

from shelfmark.llm.substrings import deep_shallow_sort, substring_dedup


def plain(rows, length=100):
    """Every string of every text in order of place, in one set."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                hit[p : p + length] = True
            seen.add(w)
        hit = hit[:-1]
        runs = int((hit & ~np.append(False, hit[:-1])[: len(hit)]).sum())
        kept = bytes(x for x, r in zip(b, hit) if not r)
        out[i] = (len(b), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def texts():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefé", k=rng.randrange(1, 7))) for _ in range(n))
    shared = [prose(40), prose(60), prose(200)]
    rows = [None, "", "x", "ab" * 400, "a" * 1000, "a" * 99, "b" * 100, "b" * 101, prose(18)]
    for _ in range(30):
        rows.append(prose(rng.randrange(5, 50)) + rng.choice(shared) + prose(rng.randrange(0, 50)) + rng.choice(shared))
    copy = prose(300)
    rows += [copy, copy, copy[:500] + "Z" + copy[500:], copy + "tail", (prose(13) + "\n") * 12]
    rng.shuffle(rows)
    return list(enumerate(rows, 50))


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, row int, spans binary").repartition(5)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup(docs, **options).collect()}
    assert found == plain(rows)


def test_removed_bytes_agree_with_a_set_of_all_strings(spark):
    check(spark, texts())


def test_crowded_hashes_deal_out_single_windows(spark):
    check(spark, texts(), crowded=2)


def folded(n, zero, one):
    """Two different strings of 2^n parts that polynomials modulo 2^64 do not tell apart."""
    bits = [0]
    for _ in range(n):
        bits += [1 - b for b in bits]
    return "".join(one if b else zero for b in bits), "".join(zero if b else one for b in bits)


def test_texts_of_one_polynomial_hash(spark):
    rng = random.Random(2)
    zero, one = ("".join(rng.choices("abc d", k=120)) for _ in range(2))
    check(spark, [(i, t) for i, t in enumerate(folded(10, zero, one))])
    check(spark, [(i, t + "tail" * 30) for i, t in enumerate(folded(11, "a", "b"))])


def test_split_of_scans_does_not_matter(spark):
    """Numbers of rows are stored once; how the files would be split later changes nothing."""
    from shelfmark.llm import substrings as S
    from shelfmark.llm.common import stored

    rows = texts()
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "split")
    kept, S.substring_spans = S.substring_spans, None

    def spans(*args, **options):
        out = kept(*args, **options)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
        return out

    try:
        spark.conf.set("spark.sql.files.minPartitionNum", 8)
        S.substring_spans = spans
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.substring_dedup(docs).collect()}
    finally:
        S.substring_spans = kept
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found == plain(rows)


def test_sorting_takes_memory_by_windows_not_by_text():
    import tracemalloc

    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 20_000_000).astype(np.uint8)
    start = rng.integers(0, len(text) - 200, 1000)
    tracemalloc.start()
    order, same = deep_shallow_sort(text, start, np.zeros(1000, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000 and [text[i : i + 100].tobytes() for i in start[order]] == sorted(text[i : i + 100].tobytes() for i in start)


def test_empty_table_and_kept_bytes(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "q" * 120 + "é"), (None, None)], "doc_id long, text string")
    assert sorted(r.kept for r in substring_dedup(rows, keep_text=True).collect()) == ["", "qé"]


def test_order_is_that_of_bytes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[100:500]
    text[2000:2300] = 120
    start = np.arange(len(text) - 99)
    group = start % 2
    order, same = deep_shallow_sort(text, start, group)
    raw = text.tobytes()
    key = [(int(group[i]), raw[i : i + 100]) for i in order.tolist()]
    assert key == sorted(key)
    assert same.tolist() == [k > 0 and key[k] == key[k - 1] for k in range(len(key))]
