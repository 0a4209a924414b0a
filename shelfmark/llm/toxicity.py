"""Toxicity by class-conditional Kneser-Ney models with shared backoff."""

from __future__ import annotations

import functools
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import ALNUM, freeing, freeing_group, mounted_path, save_array, slices, stored, utf8, words

# Fitting reads about so many labelled texts of each class: for counts, and others to calibrate on.
COUNT_TEXTS = 3000
CALIBRATION_TEXTS = 1500
DISCOUNT = 0.75
# Stretches of words whose mean is compared; a whole text is one more.
STRETCHES = (1, 4, 16)
# Both orders' means, of the text and of its stretches, and the text's size.
FEATURES = 2 * (1 + len(STRETCHES)) + 1
# Files that the pairs of the bounded sample lie in, by ranges of the first word.
BUCKETS = 16
_START = np.uint64(1)


def _bigrams(data, at):
    """(text, previous word, word) of all words; a text's first word follows a start mark."""
    doc, _, _, h = words(data, at, ALNUM)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    new = np.append(True, doc[1:] != doc[:-1])[: len(h)]
    before[new] = _START
    return doc, before, h


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted keys; keys of length n have place n for what is missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    return np.where(keys[place] == wanted, place, len(keys))


def _rows(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rows of wanted keys; zeros for what is missing."""
    place = _find(keys, wanted)
    out = np.zeros((len(wanted), rows.shape[1]))
    held = np.flatnonzero(place < len(keys))
    out[held] = rows[place[held]]
    return out


def _backed(count, total, followers, lower):
    """Discounted shares of counts; the discounts go to the lower order."""
    return np.where(total > 0, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * followers * lower) / np.maximum(total, 1), lower)


@functools.lru_cache(2)
def _pair_arrays(path: str) -> list:
    """By bucket: pairs, their counts by class, first words, and what follows those."""
    names = ("pair", "count", "first", "after")
    return [[np.load(os.path.join(path, f"{name}-{k}.npy"), mmap_mode="r") for name in names] for k in range(BUCKETS)]


@dataclass
class Model:
    """Interpolated Kneser-Ney probabilities of pairs of words by class.

    The lower order counts a word by the distinct words it follows, so that one repeated passage
    counts once. Counts are discounted, and the discounts go to the counts of both classes together,
    which back off to all words alike: a word that is rare in both classes hardly tells them apart.
    The higher order counts a word after the word before it. What a class discounts there, by the
    distinct followers of the word before, goes to the pairs of both classes together, which back off
    to the lower order; each is scaled by what the lower order of the class says of its word, so that a
    pair that is new to a class tells what its word tells. Every order sums to one.
    Pairs lie in the shared folder as sorted arrays. The last row of words is for unseen ones.
    """

    word: np.ndarray
    prior: np.ndarray
    path: str | None = None  # of the pairs
    weights: np.ndarray | None = None
    rate: float = 0.0  # of toxic texts among labelled ones

    @classmethod
    def of(cls, word: np.ndarray, preceding: np.ndarray) -> Model:
        """The lower order, from the words that precede each word in ordinary, in toxic and in all texts."""
        order = np.argsort(word)
        word, preceding = word[order], preceding[order]
        n = len(word)
        prior = np.zeros((n + 1, 3))
        for k in (2, 0, 1):  # together first: the classes back off to it
            follows = np.append(preceding[:, k], 0)
            shared = prior[:, 2] if k != 2 else np.full(n + 1, 1 / (n + 1))
            prior[:, k] = (np.maximum(follows - DISCOUNT, 0) + DISCOUNT * max((follows > 0).sum(), 1) * shared) / max(follows.sum(), 1)
        return cls(word, prior)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of words as pairs of places; a text's start comes after the unseen word."""
        first = np.where(a == _START, len(self.word) + 1, _find(self.word, a))
        return first << 32 | _find(self.word, b)

    def buckets(self, first: np.ndarray) -> np.ndarray:
        return first * BUCKETS // (len(self.word) + 2)

    def chances(self, pair: np.ndarray) -> np.ndarray:
        """p(word | word before) of ascending pairs in ordinary and in toxic texts."""
        first, to = pair >> 32, pair & 0xFFFFFFFF
        count, after = np.zeros((len(pair), 2)), np.zeros((len(pair), 7))
        cut = np.searchsorted(self.buckets(first), np.arange(BUCKETS + 1))
        for s, e, (pairs, counts, firsts, afters) in zip(cut, cut[1:], _pair_arrays(self.path)):
            count[s:e] = _rows(pairs, counts, pair[s:e])
            after[s:e] = _rows(firsts, afters, first[s:e])
        total = after[:, :2].sum(1)
        shared = _backed(count.sum(1), total, after[:, 4], self.prior[to, 2])
        left = np.where(total > 0, DISCOUNT * after[:, 4] / np.maximum(total, 1), 1.0)
        out = np.empty((len(pair), 2))
        for k in (0, 1):
            base = shared * self.prior[to, k] / self.prior[to, 2] / (after[:, 5 + k] + left)
            out[:, k] = _backed(count[:, k], after[:, k], after[:, 2 + k], base)
        return out

    def ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log of p(word | toxic) over p(word | ordinary), alone and after the word before, by word."""
        pair, back = np.unique(self.pairs(a, b), return_inverse=True)
        chance = np.log(np.stack((self.prior[pair & 0xFFFFFFFF, :2], self.chances(pair))))
        return (chance[:, :, 1] - chance[:, :, 0])[:, back]

    def features(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By text: mean ratio and highest mean of each stretch by either order, and the logarithm of the number of words."""
        n = len(at) - 1
        doc, a, b = _bigrams(data, at)
        out = np.zeros((n, FEATURES))
        if not len(b):
            return out
        size = np.bincount(doc, minlength=n)
        held = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[held]
        end = np.repeat(first + size[held], size[held])
        for order, ratio in enumerate(self.ratios(a, b)):
            k = order * (1 + len(STRETCHES))
            sums = np.concatenate(([0.0], np.cumsum(ratio)))
            out[held, k] = (sums[first + size[held]] - sums[first]) / size[held]
            for k, width in enumerate(STRETCHES, k + 1):
                to = np.minimum(np.arange(len(ratio)) + width, end)
                out[held, k] = np.maximum.reduceat((sums[to] - sums[np.arange(len(ratio))]) / width, first)
        out[:, -1] = np.log1p(size)
        return out

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = self.features(data, at)
        z = np.column_stack((x, np.ones(len(x)))) @ self.weights
        return np.where(x[:, -1] > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), self.rate)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on standardised columns."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-3, np.inf, sd)  # what hardly varies tells nothing
    z = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((z.T * (weight * p * (1 - p) + 1e-9)) @ z + ridge * np.eye(len(w)), slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= sd
    w[-1] -= (w[:-1] * mean).sum()
    return w


def _write_pairs(pairs: DataFrame, model: Model) -> str:
    """Sorted arrays of all pairs in the shared folder; each bucket is one task's, each file one rename."""
    spark = pairs.sparkSession
    path = mounted_path(spark, "toxicity")
    held = spark.sparkContext.broadcast(model)

    def numbered(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            pair = held.value.pairs(a, b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.value.buckets(pair >> 32)), pa.array(pair), *batch.columns[2:]], names=["bucket", "pair", "c0", "c1"])

    def write(key, rows):
        pair = rows["pair"].to_numpy()
        order = np.argsort(pair)
        pair, count = pair[order], np.stack([rows[c].to_numpy() for c in ("c0", "c1")], 1)[order]
        first, at = np.unique(pair >> 32, return_index=True)
        prior, to, both = held.value.prior, pair & 0xFFFFFFFF, count.sum(1)
        tilt = (both - DISCOUNT)[:, None] * prior[to, :2] / prior[to, 2:]
        after = np.add.reduceat(np.column_stack((count, count > 0, np.ones(len(pair)), tilt)), at)
        after[:, 5:] /= after[:, :2].sum(1)[:, None]
        for name, array in (("pair", pair), ("count", count), ("first", first), ("after", after)):
            save_array(os.path.join(path, f"{name}-{key[0].as_py()}.npy"), array)
        return pa.table({"bucket": [key[0].as_py()]})

    rows = pairs.select("a", "b", "c0", "c1").mapInArrow(freeing(numbered), "bucket long, pair long, c0 long, c1 long")
    filled = {r.bucket for r in rows.groupBy("bucket").applyInArrow(freeing_group(write), "bucket long").collect()}
    for k in set(range(BUCKETS)) - filled:  # so that every bucket can be mapped
        for name, shape in (("pair", 0), ("count", (0, 2)), ("first", 0), ("after", (0, 7))):
            save_array(os.path.join(path, f"{name}-{k}.npy"), np.zeros(shape, np.int64))
    return path


def fit(
    docs: DataFrame, labels: DataFrame, count_texts: int = COUNT_TEXTS, calibration_texts: int = CALIBRATION_TEXTS,
    id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
) -> Model | None:
    """Fit on bounded samples of labelled texts, chosen by a hash of the id: about ``count_texts`` a
    class for the counts, and about ``calibration_texts`` others for the logistic calibration.

    Rows with conflicting labels count with the larger one. None unless both classes occur and some
    labelled text is there.
    """
    marks = stored(
        labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label_column).cast("int").alias("y")), "labels")
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    limit = lambda texts, share: F.create_map(*[x for y, n in sizes.items() for x in (F.lit(y), F.lit(min(share, texts / n)))])[F.col("y")]
    # ids of at most the two samples: a bounded table
    chosen = marks.select("doc_id", "y", F.when(part < limit(count_texts, 0.7), 0).when(part >= 1 - limit(calibration_texts, 0.3), 1).alias("use")).where("use is not null")
    texts = stored(
        docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where("text is not null")
        .join(F.broadcast(chosen), "doc_id").select("y", "use", "text"), "labelled")

    def count(batches):
        for batch in batches:
            for y in (0, 1):
                part = batch.filter(pa.array(np.asarray(batch.column(0)) == y))
                data, places = utf8(part.column(1))
                for _, x, at in slices(data, places):
                    _, a, b = _bigrams(x, at)
                    pairs, c = np.unique(np.stack((a, b), 1), axis=0, return_counts=True)
                    none = np.zeros_like(c)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (pairs[:, 0].view(np.int64), pairs[:, 1].view(np.int64), none if y else c, c if y else none)], names=["a", "b", "c0", "c1"])

    found = texts.where("use = 0").select("y", "text").mapInArrow(freeing(count), "a long, b long, c0 long, c1 long")
    pairs = stored(found.groupBy("a", "b").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "pairs")
    held = pairs.groupBy("b").agg(F.count_if(F.col("c0") > 0).alias("c0"), F.count_if(F.col("c1") > 0).alias("c1"), F.count(F.lit(1)).alias("c2")).toArrow()
    word = np.ascontiguousarray(held["b"].to_numpy()).view(np.uint64)
    model = Model.of(word, np.stack([held[f"c{k}"].to_numpy() for k in range(3)], 1))
    model.path = _write_pairs(pairs, model)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for batch in batches:
            data, places = utf8(batch.column(1))
            for row, x, at in slices(data, places):
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(list(held.value.features(x, at)), pa.list_(pa.float64()))], names=["y", "x"])

    rows = texts.where("use = 1").select("y", "text").mapInArrow(freeing(features), "y int, x array<double>").toArrow()
    y = np.array(rows["y"].to_pylist(), float)
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), FEATURES)
    if len(set(y)) < 2:  # too few to set some aside
        rows = texts.select("y", "text").mapInArrow(freeing(features), "y int, x array<double>").toArrow()
        y = np.array(rows["y"].to_pylist(), float)
        x = np.array(rows["x"].to_pylist(), float).reshape(len(y), FEATURES)
    if not len(y):
        return None
    model.rate = sizes[1] / (sizes[0] + sizes[1])
    # weigh the classes as they occur among all labelled rows
    weight = np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))
    model.weights = _logistic(x, y, weight / weight.mean())
    return model


def toxicity(
    docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(doc_id, score, predicted) of every whole text: the calibrated comparison of both likelihoods.

    Null, empty and wordless texts get the share of toxic texts among the labelled ones; with no model all scores
    are 0. Repeated rows give repeated results, and a null id is kept. With ``keep`` the rows have
    those columns of ``docs`` instead of the id.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = [F.col(c) for c in keep] if keep else [F.col(id_column).alias("doc_id")]
    kept = docs.select(*columns)

    def run(batches):
        for batch in batches:
            data, places = utf8(batch.column(0))
            parts = [held.value.scores(x, at) if held.value else np.zeros(len(at) - 1) for _, x, at in slices(data, places)]
            score = np.concatenate(parts or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=[*batch.schema.names[1:], "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(text_column).alias("_text"), *columns).mapInArrow(freeing(run), schema)
