"""Language identification by prediction by partial matching under frozen statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from shelfmark.llm.common import slices, utf8

# Fitting: about so many texts of each language are read, and the trees of all languages together hold
# at most so many contexts, the same number each.
SAMPLE_TEXTS = 2000
CONTEXTS = 8192
ORDER = 3
UNKNOWN = "und"


@dataclass
class Model:
    """Code lengths in bits of every symbol after every kept context, by language."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    step: np.ndarray  # (context, symbol) -> context of the next byte
    bits: np.ndarray  # (context, symbol) -> bits by language
    order: int = ORDER

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact code lengths of texts, one column a language."""
        n, count = len(at) - 1, self.step.shape[1]
        out = np.zeros((n, len(self.languages)))
        held = np.flatnonzero(at[1:] > at[:-1])
        if not len(held):
            return out
        first = at[:-1][held]
        c = self.symbol[data]
        # the context before a byte is the longest kept one of up to so many bytes
        before = np.zeros(len(c), np.int32)
        step = self.step.ravel()
        for _ in range(self.order):
            after = step[before * count + c]
            before = np.empty_like(after)
            before[1:] = after[:-1]
            before[first] = 0
        out[held] = np.add.reduceat(self.bits[before * count + c], first, axis=0, dtype=np.float64)
        return out


def _counts(sample: DataFrame, order: int) -> DataFrame:
    """(lang, n, gram, c): how often runs of 1 to order+1 bytes occur within texts."""

    def run(batches):
        for batch in batches:
            by_language = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(by_language)):
                part = batch.filter(pa.array(by_language == lang))
                data, places = utf8(part.column(1))
                for _, x, at in slices(data, places):
                    x = x.astype(np.uint64)
                    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(x))  # bytes from here to the text's end
                    gram = np.zeros(len(x), np.uint64)
                    for n in range(1, order + 2):
                        if len(x) < n:
                            break
                        gram = (gram[: len(x) - n + 1] << np.uint64(8)) | x[n - 1 :]
                        value, c = np.unique(gram[left[: len(gram)] >= n], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(value)), pa.array(np.full(len(value), n)), pa.array(value.view(np.int64)), pa.array(c)],
                            names=["lang", "n", "gram", "c"],
                        )

    found = sample.mapInArrow(run, "lang string, n long, gram long, c long")
    return found.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


def fit(
    labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, contexts: int = CONTEXTS, order: int = ORDER,
    text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id",
) -> Model | None:
    """Fit on a bounded sample: about ``sample_texts`` texts a language, chosen by a hash of the id.

    Each language has a tree of its own: its most frequent strings of up to ``order`` bytes, so many
    that all trees together hold at most ``contexts``; ties go to shorter, then lesser strings. A
    symbol's probability after a context of the tree is its count over count plus distinct symbols
    there; what is left is the escape to the context without its oldest byte, down to 1/256. The trees
    share one automaton over the contexts of any of them; where a language does not hold a context, its
    longest held end decides. None if no text has a language.
    """
    rows = labelled.select(
        F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column)).alias("h")
    ).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_texts / n)))])
    place = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    grams = _counts(rows.where(place < share[F.col("lang")]).select("lang", "text"), order)
    each = max(1, (contexts - 1) // len(sizes))
    by_count = Window.partitionBy("lang").orderBy(F.desc("c"), "n", "gram")
    kept = grams.where(F.col("n") <= order).withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= each).select("lang", "n", "gram")
    nodes = [b""] + sorted({int(r.gram).to_bytes(r.n, "big") for r in kept.collect()}, key=lambda s: (len(s), s))
    number = {s: i for i, s in enumerate(nodes)}
    # counts after a language's own contexts only: no more rows than contexts times symbols
    context = kept.select("lang", (F.col("n") + 1).alias("n"), F.col("gram").alias("lead"))
    after = grams.withColumn("lead", F.shiftright("gram", 8))
    one = after.where("n = 1").select("lang", "n", "gram", "c")
    more = after.where("n > 1").join(F.broadcast(context), ["lang", "n", "lead"]).select("lang", "n", "gram", "c")
    held = one.unionByName(more).toArrow()
    languages = sorted(sizes)
    symbols = sorted({int(g) for n, g in zip(held["n"].to_pylist(), held["gram"].to_pylist()) if n == 1})
    symbol = np.zeros(256, np.int32)
    symbol[symbols] = np.arange(1, len(symbols) + 1)  # 0: a byte that fitting never met
    count = np.zeros((len(nodes), len(symbols) + 1, len(languages)))
    for lang, n, gram, c in zip(*(held[x].to_pylist() for x in ("lang", "n", "gram", "c"))):
        key = int(gram).to_bytes(n, "big")
        count[number[key[:-1]], symbol[key[-1]], languages.index(lang)] = c
    chance, step = np.empty_like(count), np.zeros(count.shape[:2], np.int32)
    byte = [None, *symbols]
    for node in sorted(nodes, key=len):
        i = number[node]
        lower = chance[number[node[1:]]] if node else np.full(count.shape[1:], 1 / 256)
        total, kinds = count[i].sum(0), (count[i] > 0).sum(0)
        seen = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, kinds / seen, 1.0)
        chance[i] = np.where(count[i] > 0, count[i] / seen, escape * lower)
        for k, b in enumerate(byte):
            s = b"" if b is None else node[max(0, len(node) + 1 - order):] + bytes([b])
            while s not in number:
                s = s[1:]
            step[i, k] = number[s]
    return Model(languages, symbol, step, -np.log2(chance).reshape(-1, len(languages)).astype(np.float32), order)


def identify(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    The language with the shortest code is predicted, the first by name on ties; the score is its
    share among all languages at equal priors. A text that is null, empty or without a letter gets
    ``und`` and 0, as all texts do where nothing was learned. Repeated rows give repeated results.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            text = batch.column(1).fill_null("")
            letter = np.asarray(pc.match_substring_regex(text, r"\pL"), bool)
            data, places = utf8(text)
            if model is None:
                pred, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            else:
                bits = np.concatenate([model.lengths(x, at) for _, x, at in slices(data, places)] or [np.zeros((0, len(model.languages)))])
                best = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                pred = [model.languages[b] if k else UNKNOWN for b, k in zip(best, letter)]
                score = np.where(letter, 1 / odds, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType)]).add("lang_pred", "string").add("score", "double")
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
