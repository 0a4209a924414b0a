"""Exact substring deduplication by deep-shallow suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from shelfmark.llm.common import freeing, freeing_group, partitions, prefix_hash, range_hash, slices, stored, utf8

LENGTH = 100

# Bytes of the strings by whose hash windows are dealt out; a window is dealt by its smallest one.
GRAM = 32
# Bytes to which multikey quicksort goes; what is alike beyond is left to blind tries.
SHALLOW = 32
# Distinct stretches of one smallest hash beyond which its windows are dealt out one by one.
CROWDED = 2000
# Bytes whose windows are hashed together, and windows that are sorted together, in a task.
SCAN_BYTES = 1 << 20
SORTED_WINDOWS = 500_000
# Stretches that a task holds before it sends them on.
SENT_STRETCHES = 200_000
# Bytes of text for each bucket that windows are dealt to, at most.
BUCKET_BYTES = 16 << 20


# --- suffix sorting -----------------------------------------------------------------------


class _BlindTrie:
    """Strings of one length in order: inner nodes hold only where children differ."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    def insert(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = (s, [member])
            return
        node, path = self.root, []
        while len(node) == 3:  # blind descent: (depth, children, some leaf)
            path.append(node)
            node = node[1].get(s[node[0]]) or node[2]
        while len(node) == 3:
            node = node[2]
        other = node[0]
        if other == s:
            node[1].append(member)
            return
        n = len(s)
        apart = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        at = n - 1 - (apart.bit_length() - 1) // 8
        leaf, parent = (s, [member]), None
        for x in path:
            if x[0] >= at:
                break
            parent = x
        below = self.root if parent is None else parent[1].get(s[parent[0]])
        if below is not None and len(below) == 3 and below[0] == at:
            below[1][s[at]] = leaf
            return
        if below is None:
            parent[1][s[parent[0]]] = leaf
            return
        inner = (at, {s[at]: leaf, other[at]: below}, node)
        if parent is None:
            self.root = inner
        else:
            parent[1][s[parent[0]]] = inner

    def leaves(self):
        stack = [self.root]
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node[1]


def _eight(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number; beyond the text is 0."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        place = at + k
        if len(at) and place.max() >= len(text):
            byte = np.where(place < len(text), text[np.minimum(place, len(text) - 1)], 0)
        else:
            byte = text[place]
        out |= byte.astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def deep_shallow_sort(text: np.ndarray, start: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW):
    """Order of suffixes within groups by their first ``length`` bytes, and whether each equals the one before.

    Multikey quicksort, eight bytes a step and only over what is still tied, to the shallow depth;
    each set of suffixes alike that far is then ordered by a blind trie. Suffixes are that long.
    Arrays are as long as the suffixes are many, whatever the text holds beside them.
    """
    word = _eight(text, start)
    order = np.lexsort((word, group))
    word = word[order]
    tied = np.append(False, (word[1:] == word[:-1]) & (group[order[1:]] == group[order[:-1]]))
    depth = 8
    while depth < min(shallow, length - 7):
        spot = np.flatnonzero(tied | np.append(tied[1:], False))  # places of sets of two or more
        if not len(spot):
            break
        own = np.cumsum(~tied[spot])
        word = _eight(text, start[order[spot]] + depth)
        inner = np.lexsort((word, own))
        order[spot] = order[spot][inner]
        word = word[inner]
        tied[spot[1:]] &= word[1:] == word[:-1]
        depth += 8
    spot = np.flatnonzero(tied | np.append(tied[1:], False))
    if not len(spot):
        return order, tied
    head = np.append(np.flatnonzero(~tied[spot]), len(spot))
    members, raw = order[spot].tolist(), memoryview(text)
    places, out, same = start[order[spot]].tolist(), [], np.ones(len(spot), bool)
    for s, e in zip(head.tolist(), head[1:].tolist()):
        trie = _BlindTrie()
        for i in range(s, e):
            trie.insert(bytes(raw[places[i] + depth : places[i] + length]), members[i])
        for leaf in trie.leaves():
            same[len(out)] = False
            out += leaf
    order[spot], tied[spot] = out, same
    return order, tied


# --- dealing out windows ------------------------------------------------------------------


def _stretches(x: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Runs of windows with one smallest gram hash: (text, start, windows, hash, both halves of the content's hash, whether it may hold a string twice)."""
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, bool)]
    n = len(x) - length + 1
    if n < 1:
        return empty
    sums = prefix_hash(x)
    place = np.arange(len(x) - gram + 1)
    h = range_hash(sums, place, place + gram)
    low, width, want = h, 1, length - gram + 1
    while 2 * width <= want:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[want - width : want - width + n])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    whole = np.arange(n) + length <= at[text + 1]
    new = np.append(True, (low[1:] != low[:-1]) | (text[1:] != text[:-1])) & whole
    new |= whole & ~np.append(False, whole[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return empty
    # windows of a run are whole and adjacent, so their number is told by the next run or the text's end
    end = np.minimum(np.append(start[1:], n), at[text[start] + 1] - length + 1)
    first = np.concatenate(([0], np.cumsum(h[:n] == low)))
    twice = first[end - 1] > first[start]
    raw = memoryview(np.ascontiguousarray(x))
    content = b"".join([xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(start.tolist(), (end + length - 1).tolist())])
    left, right = np.frombuffer(content, np.uint64).reshape(-1, 2).T
    return text[start], start, end - start, low[start], left, right, twice


def _rows(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.append(np.flatnonzero(np.append(True, np.diff(bucket) != 0)), len(order)) if len(order) else np.zeros(1, np.int64)
    arrays = [pa.array(bucket[cut[:-1]].astype(np.int64))]
    for c in columns:  # one buffer a column, cut where buckets end
        c = np.ascontiguousarray(c[order])
        width = c.nbytes // max(1, len(c))
        arrays.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * width).astype(np.int32)), pa.py_buffer(c)]))
    return pa.RecordBatch.from_arrays(arrays, names=["k", *(f"c{i}" for i in range(len(columns)))])


def _blobs(n: int) -> str:
    return "k long, " + ", ".join(f"c{i} binary" for i in range(n))


def _columns(rows: pa.Table, kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows[f"c{i}"].to_pylist()), kind) for i, kind in enumerate(kinds)]


def _first_of_equal(hash_, left, right, doc, row, start):
    """Sort by content and place; whether each is the first of its content."""
    order = np.lexsort((start, row, doc, right, left, hash_))
    h, a, b = hash_[order], left[order], right[order]
    return order, np.append(True, (h[1:] != h[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]


# Hash, both halves of the content's hash, doc, row, start, windows, mark.
_KINDS = (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int32, np.int8)
_DEAD = 2  # a stretch whose content also stands earlier


def _scanned(batches, length: int, gram: int, buckets: int):
    """Stretches of all texts by bucket, with the later ones of equal stretches marked; a run of
    texts with so many stretches is sent on before the next is read."""
    for batch in batches:
        row, doc = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        data, places = utf8(batch.column(2))
        found, count = [], 0
        for base, x, at in slices(data, places, SCAN_BYTES):
            text, start, n, h, left, right, twice = _stretches(x, at, length, gram)
            own = text + base
            found.append((h, left, right, doc[own], row[own], start - at[text], n.astype(np.int32), twice.astype(np.int8)))
            count += len(h)
            if count >= SENT_STRETCHES:
                yield _marked(found, buckets)
                found, count = [], 0
        if found:
            yield _marked(found, buckets)


def _marked(found: list, buckets: int) -> pa.RecordBatch:
    held = [np.concatenate(c) for c in zip(*found)]
    found.clear()
    order, first = _first_of_equal(*held[:6])
    for i, c in enumerate(held):
        held[i] = c[order]
    held[7] = np.where(first, held[7], _DEAD).astype(np.int8)
    return _rows((held[0] % np.uint64(buckets)).astype(np.int64), held)


def numbered(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: list | None = None) -> DataFrame:
    """(row, doc, text, head), stored: rows numbered as they are scanned. Later steps read the
    numbers, so it does not matter how a scan would be split by then."""
    columns = [F.col(c) for c in keep] if keep else [F.col(id_column).alias("doc_id")]
    return stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_column).cast("long"), F.lit(np.iinfo(np.int64).max)).alias("doc"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.struct(*columns).alias("head")), "numbered", "zstd")


def _bucket_count(rows: DataFrame) -> int:
    """As many buckets as shuffles have partitions, and more where they would hold too many bytes."""
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(rows.sparkSession), 1, -(-held // BUCKET_BYTES))


def substring_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """(row, spans): by text of ``numbered`` rows the byte ranges covered by strings of ``length`` bytes that also start earlier.

    Spans are pairs of 32-bit numbers as bytes, unmerged.

    Equal windows have equal smallest gram hashes, so windows are dealt by these: first only hashes
    of stretches of windows that share one. Tasks keep the first of equal stretches and mark the
    others, before and after the shuffle. Where a hash has several different stretches (or one that
    may hold a string twice), their bytes are fetched and all their windows suffix-sorted; crowded
    hashes deal out single windows instead, by the windows' own hash.
    """
    rows = rows.select("row", "doc", "text")
    buckets = _bucket_count(rows)

    def scan(batches):
        return _scanned(batches, length, gram, buckets)

    def decide(key, rows):
        h, left, right, doc, row, start, n, mark = _columns(rows, _KINDS)
        dead = mark == _DEAD
        spans = [(row[dead], start[dead], n[dead])]
        h, left, right, doc, row, start, n, mark = (c[~dead] for c in (h, left, right, doc, row, start, n, mark))
        order, first = _first_of_equal(h, left, right, doc, row, start)
        h, row, start, n, mark = (c[order] for c in (h, row, start, n, mark))
        spans.append((row[~first], start[~first], n[~first]))
        h, row, start, n, mark = (c[first] for c in (h, row, start, n, mark))
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        count = np.diff(np.append(head, len(h)))
        each = np.repeat(count, count)
        wanted = (each > 1) | (mark == 1)
        row_s, start_s, n_s = (np.concatenate(c) for c in zip(*spans))
        dead = _rows(row_s, [np.stack((start_s, start_s + n_s + (length - 1)), 1).astype(np.int32)]) if len(row_s) else None
        fetch = _rows(row[wanted], [h[wanted], start[wanted].astype(np.int32), n[wanted], each[wanted].astype(np.int64)])
        out = [pa.Table.from_arrays([fetch.column(0), *(fetch.column(i) for i in range(1, 5)), pa.nulls(len(fetch), pa.binary())], names=["k", "c0", "c1", "c2", "c3", "spans"])]
        if dead is not None:
            out.append(pa.Table.from_arrays([dead.column(0), *(pa.nulls(len(dead), pa.binary()) for _ in range(4)), dead.column(1)], names=["k", "c0", "c1", "c2", "c3", "spans"]))
        return pa.concat_tables(out)

    decided = stored(
        rows.mapInArrow(freeing(scan), _blobs(len(_KINDS))).groupBy("k").applyInArrow(freeing_group(decide), _blobs(4) + ", spans binary"), "stretches")
    wanted = decided.where("spans is null").groupBy("k").agg(*(F.collect_list(f"c{i}").alias(f"c{i}") for i in range(4)))

    def cut_all(batches):
        out, size = [[] for _ in range(8)], 0
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["k", *(f"c{i}" for i in range(7))])
        for batch in batches:
            for i in range(len(batch)):
                for b, *held in _cut_text(batch, i, length, crowded, buckets):
                    out[0].append(b)
                    for column, value in zip(out[1:], held):
                        column.append(value)
                    size += len(held[-1])
                if size > 4 << 20:
                    yield pack(out)
                    out, size = [[] for _ in range(8)], 0
        if out[0]:
            yield pack(out)

    def sort(key, rows):
        h, sub, doc, row, start, n = _columns(rows, (np.uint64, np.int64, np.int64, np.int64, np.int32, np.int32))
        text = np.concatenate([np.zeros(0, np.uint8), *(utf8(chunk)[0] for chunk in rows["c6"].chunks)])
        base = np.cumsum(n + length - 1, dtype=np.int64) - (n + length - 1)
        _, group = np.unique(np.stack((h, sub.astype(np.uint64)), 1), axis=0, return_inverse=True)
        group = group.ravel()
        # groups in turns, so that the arrays of windows stay small whatever the bucket holds
        turn = np.argsort(group, kind="stable")
        size = np.cumsum(n[turn], dtype=np.int64)
        removed = []
        s = 0
        while s < len(turn):
            e = int(np.searchsorted(size, (size[s - 1] if s else 0) + SORTED_WINDOWS, "right"))
            e = max(e, s + 1)
            while e < len(turn) and group[turn[e]] == group[turn[e - 1]]:
                e += 1
            part = turn[s:e]
            s = e
            which = np.repeat(part, n[part])
            step = np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            order, same = deep_shallow_sort(text, base[which] + step, group[which], length)
            which, step = which[order], step[order]
            at = start[which] + step
            kind = np.cumsum(~same)
            place = np.lexsort((at, row[which], doc[which], kind))
            later = place[np.append(False, kind[place][1:] == kind[place][:-1])]
            removed.append((row[which[later]], at[later]))
        row, at = (np.concatenate(c) for c in zip(*removed))
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        new = np.append(True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length))[: len(row)]
        first = np.flatnonzero(new)
        if not len(first):
            return pa.table({"row": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        last = np.append(first[1:], len(row)) - 1
        out = _rows(row[first], [np.stack((at[first], at[last] + length), 1).astype(np.int32)])
        return pa.table({"row": out.column(0), "spans": out.column(1)})

    fetched = rows.join(wanted, rows["row"] == wanted["k"]).select("row", "doc", F.col("text").cast("binary").alias("text"), "c0", "c1", "c2", "c3")
    sorted_ = stored(fetched.mapInArrow(freeing(cut_all), _blobs(7)).groupBy("k").applyInArrow(freeing_group(sort), "row long, spans binary"), "sorted")
    return decided.where("spans is not null").select(F.col("k").alias("row"), "spans").unionByName(sorted_)


def _cut_text(batch, i: int, length: int, crowded: int, buckets: int):
    """The wanted stretches of one text, by bucket: (bucket, hash, sub, doc, row, start, windows, bytes)."""
    row, doc = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
    raw = batch.column(2)[i].as_py()
    h, start, n, count = (
        np.frombuffer(b"".join(batch.column(3 + c)[i].as_py()), kind) for c, kind in enumerate((np.uint64, np.int32, np.int32, np.int64)))
    sub = np.zeros(len(h), np.uint64)
    if (count > crowded).any():
        many = np.where(count > crowded, n, 1)
        pick = np.repeat(np.arange(len(h)), many)
        step = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
        alone = count[pick] > crowded
        h, count = h[pick], count[pick]
        start = (start[pick] + np.where(alone, step, 0)).astype(np.int32)
        n = np.where(alone, 1, n[pick]).astype(np.int32)
        at = start.astype(np.int64)
        own = range_hash(prefix_hash(np.frombuffer(raw, np.uint8)), at, at + length)
        sub = np.where(alone, own % (count // crowded + 1).astype(np.uint64) + np.uint64(1), np.uint64(0))
    bucket = ((h + sub * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)) % np.uint64(buckets)
    for b in np.unique(bucket).tolist():
        mine = np.flatnonzero(bucket == b)
        text = b"".join([raw[s : s + w + length - 1] for s, w in zip(start[mine].tolist(), n[mine].tolist())])
        k = len(mine)
        yield (int(b), h[mine].tobytes(), sub[mine].astype(np.int64).tobytes(), np.full(k, doc).tobytes(), np.full(k, row).tobytes(),
               start[mine].tobytes(), n[mine].tobytes(), text)


def _removed(spans: bytes, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    s = np.frombuffer(spans, np.int32).reshape(-1, 2)
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, s[:, 1], -1)
    inside = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(turn[::2].tolist(), turn[1::2].tolist()))


def substring_dedup(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False,
    crowded: int = CROWDED, keep: list[str] | None = None,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    Removed is each byte covered by a string of ``length`` bytes that starts earlier too: in a row
    with a smaller id, in an earlier one of rows with that id, or earlier in the same text. Matches
    never cross texts. Null and empty texts have 0 bytes; a null id counts as the largest. With
    ``keep_text`` the text that is left follows as ``kept``, without characters that lost a byte;
    with ``keep`` the rows have those columns of ``docs`` instead of the id.
    """
    placed = numbered(docs, id_column, text_column, keep)
    spans = substring_spans(placed, length, crowded=crowded)
    by_row = spans.groupBy("row").agg(F.collect_list("spans").alias("_spans")).withColumnRenamed("row", "_row")
    head = placed.schema["head"].dataType.fields
    rows = placed.select(F.col("row").alias("_row"), F.col("text").cast("binary").alias("_text"), F.col("head").alias("_head"))

    def finish(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, held in zip(batch.column(0), batch.column(1)):
                raw, cuts = text.as_py(), []
                if held.is_valid:
                    cuts = _removed(b"".join(held.as_py()), len(raw))
                ends = [0, *(p for c in cuts for p in c), len(raw)]
                kept = b"".join([raw[s:e] for s, e in zip(ends[::2], ends[1::2])])
                left = "".join([raw[s:e].decode("utf-8", "ignore") for s, e in zip(ends[::2], ends[1::2])]) if keep_text else None
                values = (len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), left)
                for column, value in zip(out, values):
                    column.append(value)
            new = [pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [*batch.column(2).flatten(), *new], names=[*(f.name for f in head), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = T.StructType(list(head))
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "string")):
        schema = schema.add(name, kind)
    out = rows.join(by_row, "_row", "left").select("_text", "_spans", "_head").mapInArrow(freeing(finish), schema)
    return out if keep_text else out.drop("kept")
