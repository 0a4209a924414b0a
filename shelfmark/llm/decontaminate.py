"""Benchmark decontamination by suffix arrays of the training texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import ALNUM, freeing, slices, utf8, words

WINDOW = 10

# Benchmark text that travels to the tasks at a time; more is searched in further blocks.
BLOCK_BYTES = 16 << 20


@dataclass
class Suffixes:
    """A block of benchmark items, ready to be searched for.

    Words are numbered from 1 within the block; 0 is any other word or the end of a text.
    """

    vocabulary: np.ndarray  # sorted hashes of words
    keys: np.ndarray  # distinct windows as big-endian word numbers
    width: np.ndarray  # words of each
    items: np.ndarray  # windows and items, as pairs sorted by window
    names: list[str]
    pairs: np.ndarray  # sorted hashes of the first two words of windows
    singles: np.ndarray  # numbers of words that are windows themselves

    @classmethod
    def of(cls, rows: list, window: int) -> Suffixes:
        rows = [r for r in rows if r[1]]
        data, at = utf8(pa.array([r[1] for r in rows], pa.string()))
        doc, _, _, h = words(data, at, ALNUM)
        vocabulary, number = np.unique(h, return_inverse=True)
        number = (number + 1).astype(">u4")
        keys, width, item, place = [], [], [], []
        first = np.searchsorted(doc, np.arange(len(rows) + 1))
        for i in range(len(rows)):
            own = number[first[i] : first[i + 1]]
            w = min(window, len(own))
            for k in range(len(own) - w + 1 if w else 0):
                keys.append(own[k : k + w].tobytes())
                width.append(w)
                item.append(i)
                place.append(k)
        kind = f"S{4 * window}"
        distinct, where = np.unique(np.array(keys, kind), return_inverse=True)
        wide = np.zeros(len(distinct), np.int64)
        wide[where] = width
        lead = np.array([np.frombuffer(k.ljust(8, b"\0")[:8], ">u4") for k in distinct.tolist()], np.uint64).reshape(-1, 2)
        return cls(
            vocabulary, distinct, wide, np.unique(np.stack([where, np.array(item, np.int64), np.array(place, np.int64)], 1), axis=0) if keys else np.zeros((0, 3), np.int64),
            [r[0] for r in rows], np.unique(lead[wide > 1, 0] << np.uint64(32) | lead[wide > 1, 1]), np.unique(lead[wide == 1, 0]),
        )

    def search(self, doc: np.ndarray, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all occurrences in a shard's words.

        The shard's suffix array holds every suffix that begins as some window does, in order of its
        first ``window`` words; each test window is then one run of it, found by binary search.
        """
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(h) or not len(self.keys):
            return empty
        place = np.searchsorted(self.vocabulary, h)
        place[place == len(self.vocabulary)] = 0
        number = np.where(self.vocabulary[place] == h, place + 1, 0).astype(np.uint32)
        number = np.append(number, np.zeros(window, np.uint32))
        doc = np.append(doc, np.full(window, -1))
        at = np.flatnonzero(number)
        two = number[at].astype(np.uint64) << np.uint64(32) | number[at + 1]
        keep = np.isin(number[at], self.singles)
        if len(self.pairs):
            place = np.searchsorted(self.pairs, two)
            place[place == len(self.pairs)] = 0
            keep |= self.pairs[place] == two
        at = at[keep]
        if not len(at):
            return empty
        rows = np.zeros((len(at), window), ">u4")
        same = np.ones(len(at), bool)
        for k in range(window):
            same = same & (doc[at + k] == doc[at]) & (number[at + k] > 0)
            rows[:, k] = np.where(same, number[at + k], 0)
        suffix = np.frombuffer(rows.tobytes(), f"S{4 * window}")
        order = np.argsort(suffix, kind="stable")
        suffix = suffix[order]
        low = np.searchsorted(suffix, self.keys, "left")
        above = np.array([k.ljust(4 * w, b"\0").ljust(4 * window, b"\xff") for k, w in zip(self.keys.tolist(), self.width.tolist())], suffix.dtype)
        high = np.searchsorted(suffix, above, "right")
        n = high - low
        found = np.repeat(np.arange(len(self.keys)), n)
        runs = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return at[order[runs]], found


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, limit: int):
    """The benchmark in blocks of about so many bytes."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // limit))
    for k in range(count):
        yield items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()


def _scan(docs: DataFrame, suffixes, window: int, locate: bool):
    """(row, doc_id, n_words, spans, items) of each text for one block, or the (places) of its matches."""

    def run(batches):
        held = suffixes.value
        for batch in batches:
            data, at = utf8(batch.column(2))
            for row, part, places in slices(data, at):
                n = len(places) - 1
                doc, s, e, h = words(part, places, ALNUM)
                first = np.searchsorted(doc, np.arange(n + 1))
                where, what = held.search(doc, h, window)
                mine = doc[where]
                if locate:
                    yield _located(held, batch, row, mine, where - first[mine], what)
                    continue
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, where, 1)
                np.add.at(edge, where + held.width[what], -1)
                covered = np.cumsum(edge[:-1]) > 0
                begins = np.flatnonzero(covered & ~(np.append(False, covered)[:-1] & (np.append(-1, doc)[:-1] == doc)))
                ends = np.flatnonzero(covered & ~(np.append(covered, False)[1:] & (np.append(doc, -1)[1:] == doc))) + 1
                owner = doc[begins]
                cut = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(
                    [pa.array(begins - first[owner]), pa.array(ends - first[owner])], names=["s", "e"]))
                seen = np.unique(np.stack([mine, what], 1), axis=0)
                low, high = np.searchsorted(held.items[:, 0], seen[:, 1]), np.searchsorted(held.items[:, 0], seen[:, 1], "right")
                count = high - low
                of = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                both = np.unique(np.stack([np.repeat(seen[:, 0], count), held.items[of, 1]], 1), axis=0)
                cut = np.searchsorted(both[:, 0], np.arange(n + 1)).astype(np.int32)
                items = pa.ListArray.from_arrays(cut, pa.array(held.names, pa.string()).take(pa.array(both[:, 1])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(np.diff(first)), spans, items],
                    names=["row", "doc_id", "n_words", "spans", "items"],
                )

    return run


def _located(held, batch, row, mine, word, what):
    low, high = np.searchsorted(held.items[:, 0], what), np.searchsorted(held.items[:, 0], what, "right")
    count = high - low
    of = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    names = pa.array(held.names, pa.string()).take(pa.array(held.items[of, 1]))
    ids = batch.column(1).take(pa.array(np.repeat(mine + row, count)))
    return pa.RecordBatch.from_arrays(
        [ids, names, pa.array(np.repeat(word, count)), pa.array(np.repeat(held.width[what], count)), pa.array(held.items[of, 2])],
        names=["doc_id", "item_id", "word", "n_words", "item_word"],
    )


def _over_blocks(docs, benchmark, window, block_bytes, id_column, text_column, item_column, locate=False, keep=None):
    own = F.struct(*keep) if keep else F.col(id_column)
    kind = docs.select(own.alias("doc_id")).schema["doc_id"].dataType
    if locate:
        schema = T.StructType([T.StructField("doc_id", kind)]).add("item_id", "string").add("word", "long").add("n_words", "long").add("item_word", "long")
    else:
        spans = T.ArrayType(T.StructType().add("s", "long").add("e", "long"))
        schema = T.StructType().add("row", "long").add("doc_id", kind).add("n_words", "long").add("spans", spans).add("items", T.ArrayType(T.StringType()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("doc_id"), F.col(text_column).alias("text"))
    found = []
    for block in _blocks(benchmark, item_column, text_column, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(Suffixes.of(block, window))
        found.append(rows.mapInArrow(freeing(_scan(docs, held, window, locate)), schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, len(found)


def window_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, word, n_words, item_word): where windows of items occur, and where in the item they stand."""
    return _over_blocks(docs, benchmark, window, block_bytes, id_column, text_column, item_column, True)[0]


def longest_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, word, n_words): the longest run of words that a document and an item have alike, first on ties.

    Windows are parts of one run where they overlap or touch and stand as far apart in the item.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("doc_id", "item_id", F.col("word") - F.col("item_word")).orderBy("word")
    ends = F.max(F.col("word") + F.col("n_words")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = window_matches(docs, benchmark, **options).withColumn("new", (F.col("word") > F.coalesce(ends, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "item_id", (F.col("word") - F.col("item_word")).alias("apart"), "run").agg(
        F.min("word").alias("word"), (F.max(F.col("word") + F.col("n_words")) - F.min("word")).alias("n_words"))
    best = F.max_by(F.struct("word", "n_words"), F.struct("n_words", -F.col("word")))
    return runs.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.word", "x.n_words")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document.

    A shard is a run of whole texts within a task; its suffix array is searched for every window of
    the benchmark, which travels in blocks of bounded bytes. Null and empty texts have no words, items
    without a text are none, windows of an item without an id hit without being listed, and items of equal text or id count once each by id. Repeated rows give
    repeated results, and a null id is kept. No shuffle unless the benchmark has several blocks. With ``keep`` the rows have
    those columns of ``docs`` instead of the id.
    """
    found, blocks = _over_blocks(docs, benchmark, window, block_bytes, id_column, text_column, item_column, keep=keep)
    if blocks > 1:
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    hit = F.aggregate(
        F.array_sort("spans"), zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["n"],
    )
    items = F.array_sort(F.array_distinct(F.array_compact("items")))
    return found.select(
        *([F.col("doc_id")[c].alias(c) for c in keep] if keep else ["doc_id"]), "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
