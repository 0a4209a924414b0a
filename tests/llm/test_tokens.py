import random
import struct
import zlib

import pytest

from shelfmark.llm.bpe import prefix_counts, token_ids
from shelfmark.llm.packing import best_fit_decreasing, best_fit_packing, lower_bound
from shelfmark.llm.tokens import fitting_chars, prefix_token_counts, token_counts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
PARTS = [*"ab cdeé'rs' lltve \n\t  12!?.,-—ñ日本   \x1c\x85zz", "<|endoftext|>", "<|endof", "'re", "'ll", " don't", "Hello world"]
ODD = [None, "", " ", "\n\n", "x" * 3000, "word " * 2000, "<|endoftext|>" * 3, " lead", "trail ", "two  blanks", "tab\tand\nline "]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def drawn(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(1, 25))) for _ in range(n)]


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_of_every_prefix_agree_with_the_library(library):
    counter = prefix_counts(PATH)
    for t in drawn(300):
        assert counter.prefixes(t).tolist() == [len(ids_of(library, t[:i])) for i in range(len(t) + 1)]
        assert len(ids_of(library, counter.truncate(t, 4))) <= 4


@pytest.mark.parametrize("remembered", [1, 7, 60])
def test_counts_stay_exact_when_the_memory_is_full(library, monkeypatch, remembered):
    from shelfmark.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    counter = bpe.PrefixCounts(PATH)
    texts = drawn(120, 8) + ODD
    for part in (texts[:40], texts[40:80], texts[80:], texts):
        assert counter.counts(part) == [len(ids_of(library, t)) for t in part]
    for t in drawn(20, 9):
        assert counter.prefixes(t).tolist() == [len(ids_of(library, t[:i])) for i in range(len(t) + 1)]


def test_ids_agree_with_the_library(library):
    texts = drawn(300, 2) + ODD
    for t, ids in zip(texts, token_ids(PATH).batch(texts)):
        assert ids == struct.pack(f"<{len(ids_of(library, t))}I", *ids_of(library, t))


def test_token_counts(spark, library):
    rows = list(enumerate(drawn(100, 3) + ODD))
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows] + [(None, "null id", 5)], "doc_id long, text string, n_tokens int")
    found = {r.doc_id: r for r in token_counts(docs, PATH, 100).collect()}
    assert len(found) == len(rows) + 1
    for i, t in rows:
        n = len(ids_of(library, t))
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 100)
    assert token_counts(docs.limit(0), PATH).count() == 0


def test_stored_prefixes_answer_budgets(spark, library):
    docs = spark.createDataFrame(list(enumerate(drawn(20, 4) + [None, ""])), "doc_id long, text string")
    held = prefix_token_counts(docs, PATH).withColumn("fit", fitting_chars("prefix_tokens", 5)).join(docs, "doc_id")
    for r in held.collect():
        text = r.text or ""
        assert r.fit == max(i for i in range(len(text) + 1) if len(ids_of(library, text[:i])) <= 5)


def test_packing_is_gapless_whole_and_certified(spark, library):
    rows = list(enumerate(drawn(150, 5) + ODD + ["many words here " * 2500]))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows] + [(3, rows[3][1], "clash"), (None, "null id", "clash")], "doc_id long, text string, offset string")
    found = best_fit_packing(docs, PATH, capacity=64, part_pieces=60).collect()
    pieces, bins = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for i, t in rows:
        ids, own = [*ids_of(library, t), 0], sorted(pieces[i], key=lambda r: r.piece)
        if i == 3:
            own = own[::2]
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:])
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    import numpy as np
    length = np.array([r.length for r in found])
    assert lower_bound(length, 64) <= len(bins) <= best_fit_decreasing(length, 64)[2] + 2
    assert {r.over_bound for r in found} == {len(bins) - lower_bound(length, 64)}
    with pytest.raises(ValueError):
        best_fit_packing(docs, PATH, part_pieces=0)
    assert best_fit_packing(docs.limit(0), PATH).count() == 0


def test_bound_never_exceeds_the_best_packing():
    import numpy as np
    rng = np.random.default_rng(0)
    for _ in range(200):
        whole = [rng.multinomial(20 - k, np.ones(k) / k) + 1 for k in rng.integers(1, 6, 8)]  # 8 exactly full bins of 20
        length = np.concatenate(whole)
        assert lower_bound(length, 20) == 8
        assert best_fit_decreasing(length, 20)[2] >= 8
