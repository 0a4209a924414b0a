"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import freeing, freeing_group, stored
from shelfmark.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42

# Variants that one task makes at most before its cell of fingerprints is split further.
CELL_VARIANTS = 4_000_000
FIRST_BITS = 8
MORE_BITS = 4
_CHUNK = 1 << 18


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text over all its word shingles."""
    if text is None:
        return 0
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(joined)]
    if len(starts) <= size:
        starts, ends = [0], [len(joined)]
    else:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _CHUNK):
        h = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])])
        total += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null and empty give 0."""

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(freeing(run), schema)


def _masks(bits: int, flips: int) -> np.ndarray:
    """All words of so many low bits with at most so many ones."""
    return np.array(
        [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)], np.uint64
    )


def _dealt(rows: DataFrame, depth: int, bits: int, half: int) -> DataFrame:
    """Send each row (depth, cell, used, fp, node) to the cells that its variants reach with more leading bits."""
    choices = F.array(*[
        F.array(*[
            F.struct(F.lit(int(m)).alias("m"), F.lit(int(m).bit_count()).alias("n")) for m in _masks(bits, half - used)
        ])
        for used in range(half + 1)
    ])
    lead = F.shiftrightunsigned(F.col("fp"), 64 - depth - bits).bitwiseAND(F.lit((1 << bits) - 1))
    return (
        rows.withColumn("x", F.explode(F.element_at(choices, F.col("used") + 1)))
        .select(
            F.lit(depth + bits).alias("depth"),
            (F.shiftleft("cell", bits).bitwiseOR(lead.bitwiseXOR(F.col("x.m")))).alias("cell"),
            (F.col("used") + F.col("x.n")).alias("used"), "fp", "node",
        )
    )


def ball_links(fps: DataFrame, radius: int = RADIUS, cell_variants: int = CELL_VARIANTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp, node) that differ in at most ``radius`` bits.

    Two such fingerprints share a variant within half the radius of both, and two that share a
    variant are that near. Variants are shuffled by their leading bits: a fingerprint travels once
    to every cell that one of its variants reaches, and the cell's task makes those variants, sorts
    them and links all holders of a variant to the smallest, so links grow with the holders and not
    with their pairs. Each link is verified. Cells with more than ``cell_variants`` variants are
    split by further leading bits until none is left.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius is even, so that both sides flip the same number of bits")
    start = fps.select(
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("used"), "fp", "node"
    )
    rows, ready, depth, bits = start, None, 0, FIRST_BITS
    while True:
        rows = stored(_dealt(rows, depth, bits, half), "cells")
        depth += bits
        counts = F.create_map(*[
            x for used in range(half + 1) for x in (F.lit(used), F.lit(len(_masks(64 - depth, half - used))))
        ])
        load = rows.groupBy("cell").agg(F.sum(F.element_at(counts, F.col("used"))).alias("load"))
        hot = stored(load.where(F.col("load") > cell_variants).select("cell"), "hot")
        done = depth >= 64 or hot.isEmpty()
        cool = rows if done else rows.join(hot, "cell", "left_anti")
        ready = cool if ready is None else ready.unionByName(cool)
        if done:
            break
        rows, bits = rows.join(hot, "cell", "left_semi"), min(MORE_BITS, 64 - depth)

    def link(key, group):
        depth = key[0].as_py()
        used, fp = np.asarray(group["used"]), np.asarray(group["fp"]).view(np.uint64)
        node = np.asarray(group["node"])
        made, who = [], []
        for u in range(half + 1):
            mine = np.flatnonzero(used == u)
            if len(mine):
                low = np.uint64((1 << (64 - depth)) - 1)
                m = _masks(64 - depth, half - u)
                made.append((fp[mine][:, None] & low ^ m[None, :]).ravel())
                who.append(np.repeat(mine.astype(np.int32), len(m)))
        made, who = np.concatenate(made), np.concatenate(who)
        # only values made more than once matter: find them before the full sort
        order = np.argsort(made, kind="stable")
        made, who = made[order], who[order]
        del order
        new = np.empty(len(made), bool)
        new[0] = True
        np.not_equal(made[1:], made[:-1], out=new[1:])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(made)))
        take = np.repeat(size > 1, size)
        who, first, size = who[take], first[size > 1], size[size > 1]
        if len(who) == 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        head = np.concatenate(([0], np.cumsum(size)[:-1]))
        least = np.repeat(np.minimum.reduceat(node[who], head), size)
        holder = np.repeat(who[head], size)
        # the smallest holder is one of the group's members, so both ends lie within the radius
        pairs = np.unique(np.stack([node[who], least], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        assert (np.bitwise_count(fp[who] ^ fp[holder]) <= radius).all()
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return ready.groupBy("depth", "cell").applyInArrow(freeing_group(link), "a long, b long")


def simhash_near_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    A null, empty or blank text has fingerprint zero and links like any other; equal fingerprints
    link; repeated rows give repeated results. A row whose id is null is returned with its
    fingerprint and no component. Ids are integers.
    """
    marks = stored(
        fingerprints(docs, id_column, text_column, size).withColumn("doc_id", F.col("doc_id").cast("long")), "fingerprints"
    )
    fps = stored(marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    found = components(ball_links(fps, radius))
    of = fps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("c"))
    return marks.join(of, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"),
    )
