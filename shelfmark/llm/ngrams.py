"""N-gram scoring: an interpolated modified Kneser-Ney model as memory-mapped sorted arrays."""

from __future__ import annotations

import functools
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import SPACED, mixed, mounted_path, partitions, save_array, slices, utf8, words

# Marks of a text's start and end among word hashes.
START, END = np.uint64(1), np.uint64(2)

# A context's pairs go to so many buckets at most, so that no frequent word fills one.
SPREAD = 16


def tokens(data: np.ndarray, at: np.ndarray):
    """(text, previous token, token) of all tokens: lower-cased words, then one end a text."""
    n = len(at) - 1
    doc, _, _, h = words(data, at, SPACED)
    size = np.bincount(doc, minlength=n)
    place = np.arange(len(h)) + doc
    out = np.empty(len(h) + n, np.uint64)
    out[place] = h
    last = np.cumsum(size + 1) - 1
    out[last] = END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[last - size] = START
    return np.repeat(np.arange(n), size + 1), before, out


def _dealt(bucket: np.ndarray, columns: list[np.ndarray]):
    """One row a bucket with its part of every column, as bytes."""
    order = np.argsort(bucket, kind="stable")
    cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)), len(order)) if len(order) else np.zeros(1, np.int64)
    held = [c[order] for c in columns]
    keys = bucket[order][cut[:-1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.astype(np.int32)), *(pa.array([c[s:e].tobytes() for s, e in zip(cut, cut[1:])], pa.binary()) for c in held)],
        names=["bucket", *(f"c{i}" for i in range(len(held)))],
    )


def _summed(keys: list[np.ndarray], values: list[np.ndarray]):
    """Distinct keys in order, with the sums of their values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))[: len(order)]
    first = np.flatnonzero(new)
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def _joined(rows: pa.Table, kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows[f"c{i}"].to_pylist()), kind) for i, kind in enumerate(kinds)]


def _blobs(n: int) -> str:
    return "bucket int, " + ", ".join(f"c{i} binary" for i in range(n))


# Word numbers and counts of pairs are stored in 32 bits; a corpus beyond that is refused, not wrapped.
_MOST = (1 << 32) - 1


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the model's few constants."""

    path: str
    buckets: int
    tokens: int  # of training, ends included
    distinct: int  # of them
    pairs: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    lower_kinds: tuple[int, int, int]

    def save(self) -> None:
        with open(os.path.join(self.path, "model.json"), "w") as f:
            json.dump(self.__dict__, f)


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; the plain one where the counts of counts have gaps."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    found = [k - (k + 1) * y * after / own if own else y for k, own, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def _classes(c: np.ndarray) -> np.ndarray:
    return np.minimum(c, 3).astype(np.int64) - 1


class _Words:
    """The word arrays of all buckets, which begin with ascending hashes."""

    def __init__(self, path: str, buckets: int):
        self.parts = [[np.load(os.path.join(path, f"{name}-{k}.npy"), mmap_mode="r") for name in ("word", "count")] for k in range(buckets)]
        self.base = np.cumsum([0] + [len(p[0]) for p in self.parts])
        self.buckets = buckets

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The rank of each sorted hash among all words; -1 where it is none."""
        out = np.full(len(h), -1, np.int64)
        own = _range_bucket(h, self.buckets)
        cut = np.searchsorted(own, np.arange(self.buckets + 1))
        for k in range(self.buckets):
            mine, held = h[cut[k] : cut[k + 1]], self.parts[k][0]
            if len(mine) and len(held):
                place = np.searchsorted(held, mine)
                place[place == len(held)] = 0
                out[cut[k] : cut[k + 1]] = np.where(held[place] == mine, place + self.base[k], -1)
        return out

    def gather(self, arrays: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        """Rows of per-bucket arrays by ascending rank."""
        cut = np.searchsorted(numbers, self.base)
        parts = [a[numbers[s:e] - b] for a, b, s, e in zip(arrays, self.base, cut, cut[1:])]
        return np.concatenate(parts) if parts else np.zeros(0)


def _range_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pair_bucket(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    spread = mixed(b.astype(np.uint64)) % np.uint64(SPREAD)
    return (mixed(a.astype(np.uint64) + np.uint64(7)) + spread * np.uint64(0x9E3779B1)) % np.uint64(buckets)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of sorted wanted keys, -1 for missing ones."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    return np.where(keys[place] == wanted, place, -1)


@functools.lru_cache(4)
def _word_arrays(path: str, buckets: int) -> _Words:
    return _Words(path, buckets)


def _texts(docs: DataFrame, text_column: str) -> DataFrame:
    return docs.select(F.col(text_column).alias("text"))


def fit(docs: DataFrame, text_column: str = "text", buckets: int | None = None) -> Model:
    """Count all texts and write the model to the shared folder.

    Three rounds, each one scan or shuffle of sums: counts of words, in buckets by hash range, whose
    rank is their number; counts of pairs of numbers, in buckets that split frequent contexts; and
    sums of the pairs by context and by follower, in the buckets of the words. Every task sums
    before it shuffles, and a bucket's task writes its sorted arrays, each file by one rename, so a
    repeated task leaves the same files.
    """
    spark = docs.sparkSession
    buckets = buckets or max(partitions(spark), 1)
    path = mounted_path(spark, "ngrams")
    texts = _texts(docs, text_column)

    def count_words(batches):
        for batch in batches:
            data, places = utf8(batch.column(0))
            found = [np.unique(tokens(x, at)[2], return_counts=True) for _, x, at in slices(data, places)]
            if found:
                (h,), (c,) = _summed([np.concatenate([f[0] for f in found])], [np.concatenate([f[1] for f in found])])
                yield _dealt(_range_bucket(h, buckets), [h, c])

    def write_words(key, rows):
        k = key[0].as_py()
        h, c = _joined(rows, (np.uint64, np.int64))
        (h,), (c,) = _summed([h], [c])
        save_array(os.path.join(path, f"word-{k}.npy"), h)
        save_array(os.path.join(path, f"count-{k}.npy"), c)
        return pa.table({"bucket": pa.array([k], pa.int32()), "n": [len(h)], "c": [int(c.sum())]})

    sizes = texts.mapInArrow(count_words, _blobs(2)).groupBy("bucket").applyInArrow(write_words, "bucket int, n long, c long").collect()
    filled = {r.bucket for r in sizes}
    for k in set(range(buckets)) - filled:  # so that every bucket can be mapped
        save_array(os.path.join(path, f"word-{k}.npy"), np.zeros(0, np.uint64))
        save_array(os.path.join(path, f"count-{k}.npy"), np.zeros(0, np.int64))
    distinct, total = sum(r.n for r in sizes), sum(r.c for r in sizes)
    if distinct >= _MOST:
        raise OverflowError(f"{distinct} different words do not fit numbers of 32 bits")

    def numbered(held: _Words, x, at):
        """Pairs of numbers; the start of a text is numbered after all words."""
        _, a, b = tokens(x, at)
        value, back = np.unique(b, return_inverse=True)
        number = held.numbers(value)[back]
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[a == START] = distinct
        return before, number

    def count_pairs(batches):
        held = _word_arrays(path, buckets)
        for batch in batches:
            data, places = utf8(batch.column(0))
            keys, counts = [], []
            for _, x, at in slices(data, places):
                a, b = numbered(held, x, at)
                key, c = np.unique(a << 32 | b, return_counts=True)
                keys.append(key)
                counts.append(c)
            if keys:
                (key,), (c,) = _summed([np.concatenate(keys)], [np.concatenate(counts)])
                a, b = (key >> 32).astype(np.uint32), (key & 0xFFFFFFFF).astype(np.uint32)
                yield _dealt(_pair_bucket(a, b, buckets), [a, b, c.astype(np.uint32)])

    def write_pairs(key, rows):
        k = key[0].as_py()
        a, b, c = _joined(rows, (np.uint32, np.uint32, np.uint32))
        (pair,), (c,) = _summed([a.astype(np.int64) << 32 | b], [c.astype(np.int64)])
        if c.max(initial=0) >= _MOST:
            raise OverflowError("a pair of words occurs too often for counts of 32 bits")
        save_array(os.path.join(path, f"pair-{k}.npy"), pair)
        save_array(os.path.join(path, f"pairs-{k}.npy"), c.astype(np.uint32))
        a, b = pair >> 32, pair & 0xFFFFFFFF
        kind = _classes(c)
        (context,), sums = _summed([a], [c, *((kind == i).astype(np.int64) for i in range(3))])
        if sums[0].max(initial=0) >= _MOST:
            raise OverflowError("a word is followed too often for counts of 32 bits")
        follower, kinds = np.unique(b, return_counts=True)
        base = np.concatenate((context, follower))
        own = np.minimum(np.searchsorted(word_base, base, "right") - 1, buckets - 1)
        zero = lambda n: np.zeros(n, np.uint32)
        columns = [base.astype(np.uint32), *(np.concatenate((s.astype(np.uint32), zero(len(follower)))) for s in sums),
                   np.concatenate((zero(len(context)), kinds.astype(np.uint32)))]
        out = pa.Table.from_batches([_dealt(own, columns)])
        ones = [int((c == i).sum()) for i in range(1, 5)]
        head = pa.table({"bucket": pa.array([-1], pa.int32()), **{f"c{i}": pa.array([np.array(ones if not i else [len(pair)], np.int64).tobytes()]) for i in range(6)}})
        return pa.concat_tables([out, head.cast(out.schema)])

    at = {r.bucket: r.n for r in sizes}
    word_base = np.cumsum([0] + [at.get(k, 0) for k in range(buckets)])

    def write_sums(key, rows):
        k = key[0].as_py()
        if k < 0:
            found = np.frombuffer(b"".join(rows["c0"].to_pylist()), np.int64).reshape(-1, 4).sum(0)
            pairs = int(np.frombuffer(b"".join(rows["c1"].to_pylist()), np.int64).sum())
            return pa.table({"part": [0], "n": [[*map(int, found), pairs]]}, pa.schema([("part", pa.int32()), ("n", pa.list_(pa.int64()))]))
        number, *sums = (c.astype(np.int64) for c in _joined(rows, [np.uint32] * 6))
        (number,), sums = _summed([number], sums)
        # the start of texts is a context beyond the last word
        table = np.zeros((word_base[k + 1] - word_base[k] + (k == buckets - 1), 5), np.int64)
        table[number - word_base[k]] = np.stack(sums, 1)
        save_array(os.path.join(path, f"sums-{k}.npy"), table)
        ones = [int((table[:, 4] == i).sum()) for i in range(1, 5)]
        return pa.table({"part": [1], "n": [[*ones, int((table[:, 4] > 0).sum())]]}, pa.schema([("part", pa.int32()), ("n", pa.list_(pa.int64()))]))

    ends = (
        texts.mapInArrow(count_pairs, _blobs(3)).groupBy("bucket").applyInArrow(write_pairs, _blobs(6))
        .groupBy("bucket").applyInArrow(write_sums, "part int, n array<long>").collect()
    )
    counted = [np.sum([r.n for r in ends if r.part == part] or [[0] * 5], axis=0) for part in (0, 1)]
    for k in range(buckets):
        for name, kind in (("pair", np.int64), ("pairs", np.uint32)):
            if not os.path.exists(file := os.path.join(path, f"{name}-{k}.npy")):
                save_array(file, np.zeros(0, kind))
        if not os.path.exists(file := os.path.join(path, f"sums-{k}.npy")):
            save_array(file, np.zeros((word_base[k + 1] - word_base[k] + (k == buckets - 1), 5), np.int64))
    lower_kinds = (int(counted[1][0]), int(counted[1][1]), int(counted[1][4] - counted[1][0] - counted[1][1]))
    model = Model(path, buckets, int(total), int(distinct), int(counted[0][4]), _discounts(*counted[0][:4]), _discounts(*counted[1][:4]), lower_kinds)
    model.save()
    return model


class Scorer:
    """Log-probabilities of texts from the mapped arrays."""

    def __init__(self, model: Model):
        self.model, self.words = model, _word_arrays(model.path, model.buckets)
        load = lambda name: [np.load(os.path.join(model.path, f"{name}-{k}.npy"), mmap_mode="r") for k in range(model.buckets)]
        self.pair, self.pairs, self.sums = load("pair"), load("pairs"), load("sums")
        self.counts = [p[1] for p in self.words.parts]

    def score(self, data: np.ndarray, at: np.ndarray):
        """By text: tokens, known tokens, base score and model score (log10)."""
        m, n = self.model, len(at) - 1
        doc, before, token = tokens(data, at)
        value, back = np.unique(token, return_inverse=True)
        known = self.words.numbers(value)
        rank = np.flatnonzero(known >= 0)
        count = np.zeros(len(value), np.int64)
        count[rank] = self.words.gather(self.counts, known[rank])
        sums = np.zeros((len(value) + 1, 5))
        sums[rank] = self.words.gather(self.sums, known[rank])
        if m.buckets and len(self.sums[-1]):
            sums[-1] = self.sums[-1][-1]  # the start of texts
        # lower order: by the distinct tokens that a token follows, down to all tokens and one unknown alike
        cont, (d1, d2, d3) = sums[:-1, 4], m.lower
        off = np.select([cont >= 3, cont == 2, cont == 1], [d3, d2, d1], 0.0)
        left = sum(d * k for d, k in zip(m.lower, m.lower_kinds)) / m.pairs if m.pairs else 1.0
        low = (cont - off) / max(m.pairs, 1) + left / (m.distinct + 1)
        # higher order
        place = back.copy()
        context = np.empty(len(back), np.int64)
        context[1:] = back[:-1]
        context[before == START] = len(value)
        number = np.append(known, m.distinct)
        a, b = number[context], known[place]
        both = np.flatnonzero((a >= 0) & (b >= 0))
        pair, spot = np.unique(a[both] << 32 | b[both], return_inverse=True)
        found = np.zeros(len(pair))
        own = _pair_bucket(pair >> 32, pair & 0xFFFFFFFF, m.buckets).astype(np.int64)
        for k in np.unique(own).tolist():
            mine = np.flatnonzero(own == k)
            at_pair = _find(self.pair[k], pair[mine])
            hit = at_pair >= 0
            found[mine[hit]] = self.pairs[k][at_pair[hit]]
        c = np.zeros(len(back))
        c[both] = found[spot]
        e1, e2, e3 = m.discounts
        off = np.select([c >= 3, c == 2, c == 1], [e3, e2, e1], 0.0)
        total = sums[:, 0]
        share = (sums[:, 1] * e1 + sums[:, 2] * e2 + sums[:, 3] * e3) / np.maximum(total, 1)
        share = np.where(total > 0, share, 1.0)
        chance = (c - off) / np.maximum(total, 1)[context] + share[context] * low[place]
        base = np.log10((count + 1.0) / (m.tokens + (m.distinct + 1)))[back]
        return (
            np.bincount(doc, minlength=n), np.bincount(doc, (count > 0)[back], n).astype(np.int64),
            np.bincount(doc, base, n), np.bincount(doc, np.log10(chance), n),
        )


@functools.lru_cache(2)
def _scorer(model: Model) -> Scorer:
    return Scorer(model)


def score_texts(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every whole text.

    Null and empty texts have one token, the end. With nothing learned every token has the base
    chance of one unknown token. Repeated rows give repeated results, and a null id is kept.
    """

    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            data, places = utf8(batch.column(1))
            for row, x, at in slices(data, places):
                count, known, base, score = scorer.score(x, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(count)), pa.array(count), pa.array(known), pa.array(np.full(len(count), model.tokens)),
                     pa.array(base), pa.array(score), pa.array(10.0 ** np.minimum(-score / count, 300))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType)])
    for name in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(name, "long")
    for name in ("base_score", "score", "perplexity"):
        schema = schema.add(name, "double")
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
