"""The folded memo against one that is walked event by event."""

import random

import numpy as np
import pytest

from shelfmark.operators.context import Transitions, _KINDS, context_memo


class PlainMemo:
    def __init__(self, limit):
        self.limit, self.param, self.settled, self.probes, self.misses = limit, None, False, 0, 0

    def tell(self, event, param):
        if event == "ask":
            if self.param:
                if self.misses < self.limit:
                    self.misses += 1
                    return 2
                return 1
            if self.settled:
                return 0
            if self.probes >= self.limit:
                self.settled = True
                return 0
            self.probes += 1
            return 2
        if event == "found" and not self.param:
            self.param, self.settled = param, True
        elif event == "credit":
            self.misses = 0
        elif event == "settle":
            self.settled = True
        return 0

    def told(self):
        if self.param:
            return self.param, None, self.misses, "retired" if self.misses >= self.limit else "known"
        return None, None if self.settled else self.probes, 0, "settled" if self.settled else "probing"


def log(rng, n):
    return rng.choices(["ask", "found", "credit", "settle"], weights=[8, 1, 1, 0.3], k=n)


@pytest.mark.parametrize("parts", [1, 7])
def test_memo_of_hosts(spark, parts):
    rng = random.Random(parts)
    rows, memos = [], {}
    seq = list(range(4000))
    rng.shuffle(seq)
    for k in sorted(seq):
        host = rng.choice(["hot"] * 5 + [f"h{i}" for i in range(400)])
        (event,) = log(rng, 1)
        param = rng.choice("xyz") if event == "found" else None
        rows.append((host, event, param, k))
        memos.setdefault(host, PlainMemo(4)).tell(event, param)
    rows += [(None, "ask", None, 1), ("", "ask", None, 2), ("other", "seen", None, 3)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "host string, event string, param string, seq long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = {r.host: tuple(r)[1:] for r in context_memo(frame, ["seq"], parts=parts).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {h: m.told() for h, m in memos.items()}
    assert context_memo(frame.limit(0), ["seq"]).count() == 0


def test_offers_and_composition():
    rng = random.Random(3)
    for limit in (1, 4):
        moves = Transitions(limit)
        for n in (1, 2, 3, 17, 64):
            events = log(rng, n)
            kind = np.array([_KINDS.index(e) for e in events])
            memo = PlainMemo(limit)
            expected = [memo.tell(e, "p") for e in events]
            offered, state = moves.walked(kind, 0)
            assert offered.tolist() == expected and moves.composed(kind, np.zeros(n, int))[0, 0] == state


def test_alternates_retire_and_are_kept_by_credit():
    memo = PlainMemo(4)
    moves = Transitions(4)
    kinds = [1] + [0] * 5
    assert moves.walked(np.array(kinds), 0)[0].tolist() == [0, 2, 2, 2, 2, 1]
    assert moves.walked(np.array([1] + [0, 2] * 5 + [0]), 0)[0].tolist()[-1] == 2 and memo.told()[3] == "probing"


def test_stream_for_any_order_of_arrival(spark, tmp_path):
    from pyspark.sql import functions as F

    from shelfmark.streaming import jobs as S
    from shelfmark.streaming.buckets import read_buckets

    rng = random.Random(6)
    rows, memos = [], {}
    for k in range(300):
        host = rng.choice(["hot", "hot", "a", "b", "c"])
        (event,) = log(rng, 1)
        rows.append((host, event, f"p{k}" if event == "found" else None, k))
        memos.setdefault(host, PlainMemo(4)).tell(event, rows[-1][2])
    rng.shuffle(rows)
    schema = "host string, event string, param string, seq long"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(source)
        S.stream_context_memo(
            spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "checkpoint"), ["seq"], F.floor(F.col("seq") / 25), buckets=4)
    found = {r.host: tuple(r)[1:] for r in read_buckets(spark, table).collect()}
    assert found == {h: m.told() for h, m in memos.items()}
