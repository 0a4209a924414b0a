"""Best-fit packing of documents into token sequences, certified by dual-feasible bounds."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.bpe import token_ids
from shelfmark.llm.common import SLICE_BYTES, freeing, freeing_group, slices, stored, utf8

CAPACITY = 2048

# Pieces that one task packs together.
PART_PIECES = 50_000
# Bits of a sequence's number: its bin within a part, then the part; the round is above them.
BIN_BITS, PART_BITS = 24, 26


def pieces(
    docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of whole texts and an end id, cut where longer than the capacity.

    All pieces but the first are full; the first one is what remains.
    """

    def run(batches):
        coder, end = token_ids(vocabulary_path), end_id.to_bytes(4, "little")
        for batch in batches:
            data, at = utf8(batch.column(1))
            for row, _, part in slices(data, at, SLICE_BYTES):
                n = len(part) - 1
                out = [[], [], [], [], []]
                for i, ids in enumerate(coder.batch(batch.column(1).slice(row, n).to_pylist()), row):
                    ids = memoryview(ids + end)
                    total = len(ids) // 4
                    cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(out, (i, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(out[0])), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        coder.forget()

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(freeing(run), schema)


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each piece, longest first into the fullest bin that takes it, and the number of bins."""
    order = np.argsort(-length, kind="stable")
    bin_of, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    free, room, n = defaultdict(list), 0, 0  # bins by free room, and the set of rooms that occur
    for i, size in zip(order.tolist(), length[order].tolist()):
        fits = room >> size
        if fits:
            left = size + ((fits & -fits).bit_length() - 1)
            own = free[left].pop()
            if not free[left]:
                room ^= 1 << left
        else:
            left, own, n = capacity, n, n + 1
        bin_of[i], offset[i] = own, capacity - left
        left -= size
        if left:
            if not free[left]:
                room |= 1 << left
            free[left].append(own)
    return bin_of, offset, n


def lower_bound(length: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """No packing needs fewer bins: the best of two families of dual-feasible functions.

    The first drops pieces below a threshold and makes those above its complement whole; the second
    rounds k-fold lengths down to parts of k. Sums of such values over any one bin are at most 1.
    """
    count = np.bincount(length, times, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    below = np.maximum(t - 1, 0)
    whole = n[-1] - n[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[below], 0)
    best = int(np.max(whole + -(-middle // capacity)))
    for k in range(1, 51):
        up = (k + 1) * size
        value = np.where(up % capacity == 0, size * k, up // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack(pool: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    """Deal the pool anew to so many parts, pack each, and certify it.

    Full bins are closed. A part whose bins meet its bound closes all others but the emptiest.
    """

    def pack(group):
        length = np.asarray(group["length"])
        own, offset, bins = best_fit_decreasing(length, capacity)
        fill = np.bincount(own, length, bins)
        shut = (fill == capacity) | ((bins <= lower_bound(length, capacity)) & (np.arange(bins) != fill.argmin()))
        part = group["part"][0].as_py()
        return pa.table({
            **{c: group[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "copy")},
            "sequence_id": pa.array((np.int64(number) << (PART_BITS + BIN_BITS)) | (np.int64(part) << BIN_BITS) | own), "offset": pa.array(offset),
            "closed": pa.array(shut[own]),
        })

    grouped = freeing_group(lambda key, group: pack(group))
    mixed = F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(number)), F.lit(parts)).cast("int")
    kept = T.StructType([f for f in pool.schema if f.name not in ("sequence_id", "offset", "closed")])
    out = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("closed", T.BooleanType())])
    return pool.select(*kept.names, mixed.alias("part")).groupBy("part").applyInArrow(grouped, out)


def best_fit_packing(
    docs: DataFrame,
    vocabulary_path: str,
    capacity: int = CAPACITY,
    part_pieces: int = PART_PIECES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, over_bound) of every piece of every document.

    Pieces are dealt to parts of about ``part_pieces`` by a hash, and each part is packed best fit
    decreasing. Dual-feasible bounds certify parts that need no bin less; those give only their
    emptiest bin to a common pool, the others all bins that are not full. The pool is dealt anew to
    fewer parts and packed again, until the bins of all parts meet the bound of all pieces or one part
    holds the whole pool. A round that would not lower the number of bins is dropped and the pool is
    dealt once more; a second one in a row ends it. ``over_bound`` is how many sequences there are
    beyond the bound, the same on all rows. Null and empty texts have one piece that holds the end id
    alone. Repeated rows are packed as often as they occur, and it does not matter which of equal
    lengths comes first; an empty table gives no rows.
    """
    if not 0 < part_pieces < 1 << (BIN_BITS - 1):
        raise ValueError(f"part_pieces {part_pieces}: at least 1 and fewer than {1 << (BIN_BITS - 1)}")
    cut = stored(
        pieces(docs, vocabulary_path, capacity, 0, id_column, text_column).withColumn("copy", F.monotonically_increasing_id()), "pieces"
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    lengths = np.array([(r.length, r.n) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()], np.int64).reshape(-1, 2)
    least = lower_bound(lengths[:, 0], capacity, lengths[:, 1])
    done, pool, shut, held, number, idle = None, cut, 0, None, 0, 0
    while True:
        parts = max(1, -(-pool.count() // part_pieces))
        packed = stored(_pack(pool, number, parts, capacity), "packed")
        closed, still = (packed.where(c).select("sequence_id").distinct().count() for c in ("closed", "not closed"))
        number += 1
        if held is not None and closed + still >= held:
            idle += 1
            if idle == 2 or parts == 1:
                break
            continue
        kept = packed.where("closed").select(*names)
        done, pool, shut, held, idle = kept if done is None else done.unionByName(kept), packed.where("not closed"), shut + closed, still, 0
        if shut + held <= least or not still or parts == 1:
            break
    return done.unionByName(pool.select(*names)).withColumn("over_bound", F.lit(int(shut + held - least)).cast("long"))
