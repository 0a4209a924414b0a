"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import stored
from shelfmark.llm.components import components

THRESHOLD = 0.98

# Fitting reads about so many vectors. Each of the tables is one stretch of a code's bits.
SAMPLE_VECTORS = 20_000
TABLES = 12
TABLE_BITS = 16
ITERATIONS = 50
# Vectors of one bucket that are compared in one task; larger buckets are compared block by block.
BLOCK = 2000
# Values of the samples and models of several lengths that the driver holds at once.
FIT_VALUES = 8 << 20


def learn_codes(vectors: np.ndarray, tables: int = TABLES, table_bits: int = TABLE_BITS, iterations: int = ITERATIONS, seed: int = 1):
    """Directions: signs of unit vectors @ directions are the bits of codes, table after table.

    Unit vectors are turned to their principal directions about the origin; a rotation is then learned
    by turns of signs and the orthogonal fit to them, which balances the directions' shares. They are
    not centred: a cosine is an angle at the origin, and about a mean that most vectors share, near
    ones would differ in many bits. One rotation gives as many bits as dimensions, at most 64; further
    ones start from other turns.
    """
    d = vectors.shape[1]
    value, axes = np.linalg.eigh(vectors.T @ vectors)
    axes = axes[:, np.argsort(-value)][:, : min(d, 64)]
    rng, out = np.random.default_rng(seed), []
    bits = tables * table_bits
    while sum(x.shape[1] for x in out) < bits:
        flat = vectors @ axes
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))
        for _ in range(iterations):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        out.append(axes @ turn)
    return np.concatenate(out, 1)[:, :bits]


def _units(batch_column: pa.Array) -> np.ndarray:
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(batch_column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(column):
    number = F.transform(column, lambda v: v.cast("double"))
    finite = F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & finite & F.exists(number, lambda v: v != 0)


def _compare(members: pa.Table, threshold: float, cross: bool):
    """By member: links found in this bucket that no earlier table holds, and the smallest member reached."""
    x, code = _units(members["vec"].combine_chunks()), np.stack(members["codes"].to_pylist())
    node, count = np.asarray(members["node"]), np.asarray(members["n"])
    table, side = members["table"][0].as_py(), np.asarray(members["side"])
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))
    order = np.argsort(node)
    x, code, count, side, node = x[order], code[order], count[order], side[order], node[order]
    near = []
    for s in range(0, len(x), 512):
        hit = x[s : s + 512] @ x.T >= threshold
        # the same pair counts in the first table that it shares
        for t in range(table):
            hit &= code[s : s + 512, t][:, None] != code[:, t][None, :]
        if cross:
            hit &= side[s : s + 512][:, None] != side[None, :]
        hit[np.arange(len(hit)), np.arange(s, s + len(hit))] = False
        links[s : s + 512] = hit @ count
        near.append(np.packbits(hit, axis=1))
    while True:
        before = root
        root = root.copy()
        for k, packed in enumerate(near):
            hit = np.unpackbits(packed, axis=1, count=len(x)).astype(bool)
            low = np.where(hit, before[None, :], len(x)).min(1)
            np.minimum(root[k * 512 : k * 512 + len(hit)], low, out=root[k * 512 : k * 512 + len(hit)])
        root = root[root]
        if (root == before).all():
            break
    some = links > 0
    return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})


def _groups(lengths, sample_vectors: int, bits: int):
    """Lengths whose samples and models together stay within ``FIT_VALUES``; a larger one is alone."""
    group, held = [], 0
    for r in lengths:
        values = (min(r.c, sample_vectors) + bits) * r.d
        if group and held + values > FIT_VALUES:
            yield group
            group, held = [], 0
        group.append(r)
        held += values
    if group:
        yield group


def _encoder(models: dict, tables: int, table_bits: int):
    def encode(batches):
        for batch in batches:
            for d, directions in models.items():
                part = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), d))
                if not len(part):
                    continue
                bit = _units(part.column(1)) @ directions >= 0
                code = bit.reshape(len(part), tables, table_bits) @ (1 << np.arange(table_bits))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(4)), pa.array(list(code.astype(np.int64)), pa.list_(pa.int64()))], names=["label", "vec", "node", "n", "codes"])

    return encode


def embedding_near_dedup(
    vectors: DataFrame, threshold: float = THRESHOLD, sample_vectors: int = SAMPLE_VECTORS, tables: int = TABLES, table_bits: int = TABLE_BITS,
    block: int = BLOCK, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; links need equal labels and cosine >= threshold.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or id, link with nothing and are components of their own (a null id has none and is kept).
    Only vectors of one length are compared. Equal vectors of a label are one class with a count: its
    rows are linked with each other.

    Codes are fitted for each length on a bounded sample and made for every class, however few a length
    has. A pair is compared, by the vectors themselves in double precision, if some table's bits are the
    same in both codes, and it counts in the first such table. Buckets over ``block`` classes are split into blocks, and each
    pair of blocks is a task of its own, so no task holds a whole bucket.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vec"), F.col(label_column).alias("label"))
    usable = F.coalesce(_usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("vec", F.when(usable, F.transform("vec", lambda v: v.cast("double") + 0.0)))
    classes = stored(
        rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").cast("long").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    lengths = classes.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").orderBy("d").collect()
    kind = classes.schema["label"].dataType
    schema = T.StructType([T.StructField("label", kind)]).add("vec", T.ArrayType(T.DoubleType())).add("node", "long").add("n", "long").add("codes", T.ArrayType(T.LongType()))
    coded = []
    for group in _groups(lengths, sample_vectors, tables * table_bits):
        size = F.size("vec")
        alike = classes.where(size.isin([r.d for r in group]))
        taken = F.lit(0)
        for r in group:
            taken = F.when(size == r.d, int(min(1.0, sample_vectors / r.c) * (1 << 30))).otherwise(taken)
        sample = alike.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= taken).select("vec").toArrow()["vec"].combine_chunks()
        d = pc.list_value_length(sample)
        models = {r.d: learn_codes(_units(sample.filter(pc.equal(d, r.d))), tables, table_bits) for r in group}
        coded.append(stored(alike.select("label", "vec", "node", "n").mapInArrow(_encoder(models, tables, table_bits), schema), "codes"))
    if not coded:
        found = spark.createDataFrame([], "node long, links long, root long")
    else:
        in_table = functools.reduce(DataFrame.unionAll, coded).select("*", F.size("vec").alias("d"), F.posexplode("codes").alias("table", "code"))
        bucket = ["label", "d", "table", "code"]
        sizes = in_table.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        dealt = in_table.join(sizes, bucket)
        blocks = F.ceil(F.col("size") / block).cast("int")
        # a class meets every block of its bucket once: its own among themselves, and each other pair
        mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = (
            dealt.withColumn("blocks", blocks).withColumn("side", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
        )
        found = dealt.groupBy(*bucket, "i", "j").applyInArrow(
            lambda key, group: _compare(group, threshold, key[4] != key[5]), "node long, links long, root long")
        found = stored(found, "links")
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(sums, "node", "left").join(linked, "node", "left").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    out = rows.join(known, ["label", "vec"], "left")
    component = F.coalesce("c", F.col("vec_id").cast("long"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
