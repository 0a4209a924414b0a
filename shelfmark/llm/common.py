"""What the corpus operators share: tables, the shared folder, and text as arrays of bytes."""

from __future__ import annotations

import ctypes
import os
import urllib.parse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.runtime import scratch_path, stored  # noqa: F401

# Bytes of text that a task turns into arrays at a time; a single longer text is taken alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dropped(df: DataFrame) -> None:
    """Remove the files of a stored table which no later step reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def mounted_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder as a path of the operating system, for memory maps."""
    url = urllib.parse.urlparse(scratch_path(spark, name))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory maps need a shared folder mounted on every executor, not {url.scheme}")
    os.makedirs(url.path, exist_ok=True)
    return url.path


def save_array(path: str, array: np.ndarray) -> None:
    """Write beside and rename, so that a repeated task replaces a file by an equal one."""
    beside = f"{path}.{os.getpid()}.tmp"
    with open(beside, "wb") as f:
        np.save(f, array)
    os.replace(beside, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(id_column: str, divisor: int):
    """The remainder of crc32 of the id's decimal text, by which contracts hold rows out."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor


# --- memory of workers --------------------------------------------------------------------


def give_back() -> None:
    """Return freed memory to the system: workers are used again, by steps that do not need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freeing(run):
    """A function for ``mapInArrow`` that gives memory back after its last batch."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def freeing_group(run):
    """A function for ``applyInArrow`` that gives memory back after each group."""

    def wrapped(key, rows):
        out = run(key, rows)
        give_back()
        return out

    return wrapped


# --- texts as bytes -----------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the n+1 places where texts begin; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, at: np.ndarray, limit: int = SLICE_BYTES):
    """Cut a column into runs of whole texts: (first row, bytes, places)."""
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


# A byte's lower-cased form, or 0 where it separates words.
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
SPACED = _lower.copy()
SPACED[[9, 10, 11, 12, 13, 32]] = 0
ALNUM = _lower.copy()
ALNUM[:0x30] = 0
ALNUM[0x3A:0x41] = 0
ALNUM[0x5B:0x61] = 0
ALNUM[0x7B:0x80] = 0

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(n, _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on every bit of its input."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(x: np.ndarray) -> np.ndarray:
    """n+1 running sums; the hash of x[s:e] is (sums[e] - sums[s]) * downs[s]."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _power("up", len(x) + 1)[: len(x)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For dealing out strings only: different strings can be made that have one hash."""
    return mixed((sums[e] - sums[s]) * _power("down", len(sums))[s])


# Words up to this many bytes are hashed together, longer ones one by one.
LONG_WORD = 256


def word_hash(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of x[s:e]: eight bytes a step, each step mixed with all before it.

    Steps are one to one, so strings of one length of up to eight bytes never share a hash.
    """
    size = e - s
    h = mixed(size.astype(np.uint64) * _BASE)
    long = np.flatnonzero(size > LONG_WORD)
    for i in long.tolist():
        h[i] = xxhash.xxh3_64_intdigest(x[s[i] : e[i]].tobytes(), LONG_WORD)
    padded = np.concatenate((x, np.zeros(8, np.uint8)))
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at, left = s[live], size[live]
    while len(live):
        step = np.zeros(len(live), np.uint64)
        for k in range(8):
            step |= np.where(left > k, padded[at + k], 0).astype(np.uint64) << np.uint64(8 * k)
        h[live] = mixed(h[live] ^ step) * _BASE
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def words(data: np.ndarray, at: np.ndarray, kept: np.ndarray):
    """Words of texts, lower-cased: (document, start, end, 64-bit hash) of each, in order."""
    x = kept[data]
    inside = np.empty(len(x) + 1, bool)
    np.not_equal(x, 0, out=inside[:-1])
    inside[-1] = False
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    first = at[:-1][at[:-1] < len(x)]
    start[first] = inside[first]
    end = inside[:-1] & ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(at, s, "right") - 1
    return doc, s, e, word_hash(x, s, e)


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text."""
    return np.bincount(doc, values, n)
