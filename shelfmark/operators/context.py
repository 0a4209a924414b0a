"""What a host needs before it prices products, as an order-dependent state folded in any grouping.

A run asks a host's memo which parameters to try, and tells it what paid off. What the memo says
depends on all that came before, but on little of it: whether a parameter is known, whether the host
is settled, and two counters that end at a limit. So each stretch of a host's log is a table from
the state before it to the state after it, two stretches in a row are one table, and no host's log
has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.operators.quality import PROBE_LIMIT

# What a log tells: a product's price was missing and the memo was asked; a parameter gave a price;
# one of the alternates did; prices came without any.
ASK, FOUND, CREDIT, SETTLE = "ask", "found", "credit", "settle"
_KINDS = [ASK, FOUND, CREDIT, SETTLE]


class Transitions:
    """States and what events make of them, for a limit.

    States 0 to limit are an unknown, unsettled host after so many probes; the next ones a known
    host after so many asks whose alternates were offered in vain; the last a settled host of which
    nothing is known. An ask offers nothing, the known parameter alone, or all there are.
    """

    NONE, ALONE, ALL = 0, 1, 2

    def __init__(self, limit: int):
        self.limit, self.known, self.settled = limit, limit + 1, 2 * limit + 2
        self.states = 2 * limit + 3
        probing, misses = np.arange(limit + 1), np.arange(limit + 1)
        same = np.arange(self.states)
        ask, offers = same.copy(), np.zeros(self.states, np.int64)
        ask[probing] = np.where(probing < limit, probing + 1, self.settled)
        offers[probing] = np.where(probing < limit, self.ALL, self.NONE)
        ask[self.known + misses] = self.known + np.minimum(misses + 1, limit)
        offers[self.known + misses] = np.where(misses < limit, self.ALL, self.ALONE)
        found, credit, settle = same.copy(), same.copy(), same.copy()
        found[probing] = found[self.settled] = self.known
        credit[self.known + misses] = self.known
        settle[probing] = self.settled
        self.table, self.offers = np.stack([ask, found, credit, settle]), np.stack([offers, *np.zeros((3, self.states), np.int64)])

    def composed(self, kind: np.ndarray, stretch: np.ndarray) -> np.ndarray:
        """By stretch, in order, the table of all its events: neighbours become one, until one is left."""
        tables = self.table[kind]
        while len(stretch) > 1 and (stretch[1:] == stretch[:-1]).any():
            first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
            at = np.arange(len(stretch)) - np.repeat(first, np.diff(np.append(first, len(stretch))))
            left = np.flatnonzero(at % 2 == 0)
            right = left + 1
            paired = (right < len(stretch)) & (stretch[np.minimum(right, len(stretch) - 1)] == stretch[left])
            both = tables[left]
            both[paired] = np.take_along_axis(tables[right[paired]], tables[left[paired]], axis=1)
            tables, stretch = both, stretch[left]
        return tables

    def walked(self, kind: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """What each event of a stretch offers from a state on, and the state after all."""
        offered = np.zeros(len(kind), np.int64)
        for i, k in enumerate(kind.tolist()):
            offered[i] = self.offers[k, state]
            state = int(self.table[k, state])
        return offered, state


def _kind(event: Column) -> Column:
    place = F.lit(None).cast("int")
    for i, name in enumerate(_KINDS):
        place = F.when(event == name, i).otherwise(place)
    return place


def stretches(events: DataFrame, order: list, limit: int = PROBE_LIMIT, parts: int | None = None, segment: Column | None = None) -> DataFrame:
    """(host, segment, row, table, param): one row for each stretch of a host's log, from ``events(host,
    event, param, ...)``; the log is cut by ranges of (host, ``order``), so a hot host has many.

    ``row`` tells the order of stretches, ``param`` is the first parameter found in one. No stretch
    goes beyond a ``segment``, a number that grows with ``order``. Rows of other events, and without
    a host, do not count.
    """
    moves = Transitions(limit)
    segment = (F.lit(0) if segment is None else segment).cast("long").alias("segment")
    known = events.select("host", segment, _kind(F.col("event")).alias("kind"), "param", F.struct(*order).alias("at")).where(
        (F.coalesce("host", F.lit("")) != "") & F.col("kind").isNotNull())
    parts = parts or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = known.repartitionByRange(parts, "host", "at").sortWithinPartitions("host", "at").withColumn("row", F.monotonically_increasing_id())

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:  # a batch of a sorted partition: stretches end where it does
            if not len(frame):
                continue
            host, segment = frame["host"].to_numpy(), frame["segment"].to_numpy()
            stretch = np.cumsum(np.append(False, (host[1:] != host[:-1]) | (segment[1:] != segment[:-1])))
            first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
            tables = moves.composed(frame["kind"].to_numpy(), stretch)
            found = frame["param"].where(frame["kind"] == _KINDS.index(FOUND))
            yield pd.DataFrame({
                "host": host[first], "segment": segment[first], "row": frame["row"].to_numpy()[first], "table": list(tables),
                "param": found.groupby(stretch).first().where(lambda p: p.notna(), None).to_numpy(),
            })

    schema = "host string, segment long, row long, table array<int>, param string"
    return placed.select("host", "segment", "kind", "param", "row").mapInPandas(compose, schema)


def folded(parts: DataFrame) -> DataFrame:
    """(host, state, param): a host's stretches put together in order, from a fresh memo on."""
    row = F.struct("segment", "row", "table", "param")
    hosts = parts.groupBy("host").agg(F.sort_array(F.collect_list(row)).alias("s"))
    state = F.aggregate("s", F.lit(0), lambda a, x: F.get(x["table"], a))
    return hosts.select("host", state.alias("state"), F.get(F.filter(F.col("s.param"), lambda p: p.isNotNull()), F.lit(0)).alias("param"))


def told(hosts: DataFrame, limit: int = PROBE_LIMIT) -> DataFrame:
    """(host, preferred_param, probes, misses, state) of folded hosts.

    ``state`` is ``known``, or ``retired`` once the alternates were offered ``limit`` times in vain;
    ``settled`` if nothing is asked of the host any more, else ``probing``.
    """
    moves = Transitions(limit)
    state = F.col("state")
    known = (state >= moves.known) & (state < moves.settled)
    misses = F.when(known, state - moves.known).otherwise(0)
    return hosts.select(
        "host", F.when(known, F.col("param")).alias("preferred_param"), F.when(state <= limit, state).alias("probes"), misses.alias("misses"),
        F.when(known & (misses >= limit), "retired").when(known, "known").when(state == moves.settled, "settled").otherwise("probing").alias("state"))


def context_memo(events: DataFrame, order: list, limit: int = PROBE_LIMIT, parts: int | None = None) -> DataFrame:
    """What each host's memo says after its whole log: ``told`` of its stretches, folded.

    ``order`` must be unique within a host. Asking an unknown host counts a probe, and settles it
    once ``limit`` were made; the first parameter found stays; asking a known host counts against its
    alternates until a credit, and ends their offer at ``limit``.
    """
    return told(folded(stretches(events, order, limit, parts)), limit)
