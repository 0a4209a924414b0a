"""Merkle manifest of a dataset: a tree a language, a tree of their roots, and a proof for every row.

Leaves are hashed in the scan, so texts are never shuffled. Proofs come from pointer jumping: each
inner node holds the siblings of the way to some ancestor; a self-join replaces that ancestor by its
own and appends its segment, so the distance doubles each round. The leaves of a run stay together
on the row of their parent and join in last, with the parent's finished segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.llm.common import dropped, stored
from shelfmark.runtime import with_global_index

FANOUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED_ONE_IN = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list) -> Column:
    """32 bytes: sha256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _joined(digests: Column) -> Column:
    """Digests of an array one after the other, as bytes."""
    return F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b))


def _beside(digests: Column, i: Column) -> tuple[Column, Column]:
    """What stands left and right of place ``i`` (from 0)."""
    return _joined(F.slice(digests, F.lit(1), i)), _joined(F.slice(digests, i + 2, F.lit(FANOUT)))


def _runs(nodes: DataFrame) -> DataFrame:
    """``(tree, pos, digests)``: runs of up to eight consecutive nodes of one level, left to right."""
    pairs = nodes.groupBy("tree", F.shiftright("pos", 3).alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("p")
    )
    return pairs.select("tree", "pos", F.col("p.digest").alias("digests"))


_PATH = "struct<before:binary,after:binary>"


def _held(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of a level as children of the next: the pointer to the parent, the siblings on the way."""
    before, after = _beside(F.col("digests"), F.col("i"))
    return nodes.select("tree", "pos", "digests", F.posexplode("digests").alias("i", "digest")).select(
        "tree", F.lit(level).alias("level"), (F.col("pos") * FANOUT + F.col("i")).alias("pos"),
        F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.col("pos").alias("up_pos"),
        F.array(F.struct(before.alias("before"), after.alias("after"))).alias("way"), F.lit(None).cast("binary").alias("subroot"),
    )


def _grown(nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of a level with their pointers, and the level above."""
    runs = stored(_runs(nodes), f"merkle-runs-{level}")
    parents = runs.select("tree", "pos", _sha(_hex(_joined(F.col("digests")))).alias("digest"))
    return _held(runs, level), parents


def _depth(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def merkle_manifest(docs: DataFrame, tampered_one_in: int = TAMPERED_ONE_IN) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    Leaves ascend by doc_id within a language (null ids first, rows of one id by their hash), runs of
    eight become their hash until one is left, and the languages' roots, null first and then by
    bytes, are put together likewise. ``proof_sha256`` is the hash of all siblings on the way up.
    ``folded_root`` is recomputed from the row as it would read if its text's A-Z were lower-cased
    where ``tampered_one_in`` divides crc32 of the id; ids that are null are left as they are.
    Equal rows are leaves of their own. An empty table gives no rows; other columns do not count.
    """
    spark = docs.sparkSession
    own = [F.col(c) for c in FIELDS]
    lowered = [*own[:-1], F.translate("text", _UPPER, _LOWER)]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered_one_in == 0
    leaves = stored(
        docs.select("doc_id", "lang", leaf_hash(own).alias("leaf"), F.when(chosen, leaf_hash(lowered)).alias("changed")), "merkle-leaves")
    placed = with_global_index(leaves, ["lang", "doc_id", "leaf"], "at")

    # one row a language: its place among languages, where its leaves begin, how many they are
    langs = placed.groupBy("lang").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    langs = stored(with_global_index(langs, ["lang"], "tree"), "merkle-langs")
    n_langs, longest = langs.agg(F.count(F.lit(1)), F.max("n")).first()
    if not n_langs:
        return leaves.select(
            "doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(False).alias("verified"))

    # Level 1: runs of leaves. A lone leaf is its language's root, and its own row there.
    own_place = F.col("at") - F.col("start")
    run = (
        placed.join(langs.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
        .groupBy("tree", F.shiftright(own_place, 3).alias("pos"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "leaf", "doc_id", "changed"))).alias("leaves"), F.first("n").alias("n"))
    )
    lone = F.col("n") == 1
    digest = F.when(lone, F.col("leaves")[0]["leaf"]).otherwise(_sha(_hex(_joined(F.col("leaves.leaf")))))
    runs = stored(run.select("tree", "pos", "leaves", lone.alias("lone"), digest.alias("digest")), "merkle-runs")

    depth = max(1, _depth(longest))
    top = _depth(n_langs)
    held, roots, nodes = [], [], runs.select("tree", "pos", "digest")
    sizes = langs.select("tree", "n")
    for level in range(1, depth + 1):
        # a language whose leaves are 8^level at most has one node left here: its root
        left = nodes.join(sizes.withColumn("_done", F.col("n") <= FANOUT**level).drop("n"), "tree")
        roots.append(left.where("_done").select("tree", F.lit(level).alias("level"), "digest"))
        if level < depth:
            below, nodes = _grown(left.where("not _done").drop("_done"), level)
            held.append(below)
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)
    subroots = stored(subroots, "merkle-subroots")

    # The tree of the languages, as tree -1; the place of a subroot in it is its language's.
    upper = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest")
    first = None
    for level in range(depth, depth + top):
        below, upper = _grown(upper, level)
        if first is None:
            first = below.drop("tree", "level", "subroot")
        else:
            held.append(below)
    root = upper.first()["digest"]
    at_root = subroots.select("tree", "level", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"))
    if first is None:  # one language: its root is the root, and nothing is above it
        held.append(at_root.select(
            "tree", "level", "pos", F.lit(None).cast("long").alias("up_tree"), F.lit(None).cast("int").alias("up_level"),
            F.lit(None).cast("long").alias("up_pos"), F.array().cast(f"array<{_PATH}>").alias("way"), "subroot"))
    else:
        seen = first.withColumnRenamed("pos", "_pos")
        held.append(at_root.join(seen, F.col("tree") == F.col("_pos")).select(
            "tree", "level", "pos", "up_tree", "up_level", "up_pos", "way", "subroot"))
        held.append(spark.createDataFrame(
            [(-1, depth + top, 0, None, None, None, [], None)],
            f"tree long, level int, pos long, up_tree long, up_level int, up_pos long, way array<{_PATH}>, subroot binary"))

    paths = held[0]
    for h in held[1:]:
        paths = paths.unionByName(h)
    paths = stored(paths, "merkle-paths-0")
    distance = 1
    while distance < depth + top - 1:
        paths, before = stored(_jumped(paths, distance), f"merkle-paths-{distance}"), paths
        dropped(before)
        distance *= 2
    ready = paths.where("level = 1").select("tree", "pos", "way", "subroot")
    return _proven(runs.join(ready, ["tree", "pos"]), F.lit(bytes(root)))


def _jumped(paths: DataFrame, distance: int) -> DataFrame:
    """Every pointer goes on to where the ancestor's points, with both segments one after the other.

    An ancestor at that distance lies that many levels above the lowest nodes, so its side shrinks
    eightfold a level; pointers that have reached the root stay.
    """
    above = paths.where(F.col("level") > distance).select(
        F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"), F.struct(
            "up_tree", "up_level", "up_pos", "way", "subroot").alias("up"))
    joined = paths.join(above, ["up_tree", "up_level", "up_pos"], "left")
    return joined.select(
        "tree", "level", "pos", F.col("up.up_tree").alias("up_tree"), F.col("up.up_level").alias("up_level"), F.col("up.up_pos").alias("up_pos"),
        F.when(F.col("up").isNotNull(), F.concat("way", "up.way")).otherwise(F.col("way")).alias("way"), F.coalesce("subroot", "up.subroot").alias("subroot"))


def _proven(runs: DataFrame, root: Column) -> DataFrame:
    """One row a leaf, with its proof, and the root folded from what the row would read.

    A segment holds what lies below its end, so only the root of a single language is not in it.
    """
    each = runs.select("way", "subroot", "lone", F.col("leaves.leaf").alias("digests"), F.posexplode("leaves").alias("i", "x"))
    before, after = _beside(F.col("digests"), F.col("i"))
    step = F.array(F.struct(before.alias("before"), after.alias("after")))
    whole = each.select(
        F.col("x.doc_id").alias("doc_id"), F.col("x.leaf").alias("leaf"), F.coalesce("x.changed", "x.leaf").alias("now"), "subroot",
        F.when(F.col("lone"), F.col("way")).otherwise(F.concat(step, "way")).alias("way"))
    siblings = F.array_join(F.transform("way", lambda s: _hex(F.concat(s["before"], s["after"]))), "")
    folded = F.aggregate("way", F.col("now"), lambda h, s: _sha(_hex(F.concat(s["before"], h, s["after"]))))
    return whole.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.coalesce("subroot", root)).alias("subroot"), _hex(root).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("_folded"),
    ).select("doc_id", "leaf", "subroot", "root", "proof_sha256", _hex(F.col("_folded")).alias("folded_root"), (_hex(F.col("_folded")) == F.col("root")).alias("verified"))
