"""URL filter: host and path rules first, then the ratio of two character language models.

URLs that a rule accepts and URLs that one rejects are the labelled data. Each side has a variable-
order Markov model of bytes: counts after contexts of up to five symbols, interpolated by how many
different symbols follow a context (Witten and Bell), down to one chance for every symbol. A URL's
difference of log-likelihoods by symbol is calibrated to a probability of being accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfmark.llm.common import slices, stored, utf8

ORDER = 5
# One in so many of the labelled URLs calibrates instead.
HELD_FOR_CALIBRATION = 5

# A symbol is a byte and 1; 0 ends a URL, and the places before its first byte hold the last one.
END, BEFORE, KINDS = 0, 257, 257
_BITS = 9


@dataclass(frozen=True)
class Rule:
    """What to do with a host and its subdomains where the path starts like this."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of_url(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of_url(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a host's ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """(name, verdict) of the longest rule that fits, the first by name and verdict of equally long ones; null without one."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.name.encode()), r.name, r.verdict), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


# --- models -------------------------------------------------------------------------------


def _windows(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """For every symbol of every URL, its end too: it and the ``order`` symbols before it, oldest first in the high bits."""
    n = len(at) - 1
    size = np.diff(at) + 1 + order
    start = np.concatenate(([0], np.cumsum(size)))
    symbols = np.full(start[-1], END, np.uint64)
    own = np.arange(len(data)) + np.repeat(start[:-1] + order - at[:-1], np.diff(at))
    symbols[own] = data.astype(np.uint64) + np.uint64(1)
    lead = (start[:-1, None] + np.arange(order)).ravel()
    symbols[lead] = BEFORE
    window = np.zeros(max(0, len(symbols) - order), np.uint64)
    for k in range(order + 1):
        window = (window << np.uint64(_BITS)) | symbols[k : k + len(window)]
    whole = np.repeat(start[:-1], size - order) + np.arange(size.sum() - n * order) - np.repeat(np.cumsum(size - order) - (size - order), size - order)
    return window[whole]


def _of_order(window: np.ndarray, k: int) -> np.ndarray:
    """The last k + 1 symbols, with a mark of how many."""
    return (window & np.uint64((1 << _BITS * (k + 1)) - 1)) | np.uint64((k + 1) << 58)


class MarkovModel:
    """Counts of windows of all orders as sorted keys, and of what follows each context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        turn = np.argsort(keys)
        self.keys, self.counts, self.order = keys[turn], counts[turn].astype(np.int64), order
        lead = (self.keys & np.uint64((1 << 58) - 1)) >> np.uint64(_BITS)
        lead |= ((self.keys >> np.uint64(58)) - np.uint64(1)) << np.uint64(58)
        self.contexts, place = np.unique(lead, return_inverse=True)
        self.totals = np.bincount(place, self.counts, len(self.contexts)).astype(np.int64)
        self.followers = np.bincount(place, minlength=len(self.contexts))

    def chance(self, window: np.ndarray) -> np.ndarray:
        """Probability of the last symbol of each window after the others."""
        p = np.full(len(window), 1 / KINDS)
        for k in range(self.order + 1):
            key = _of_order(window, k)
            context = ((key & np.uint64((1 << 58) - 1)) >> np.uint64(_BITS)) | np.uint64(k << 58)
            total, followers = _found(self.contexts, context, self.totals), _found(self.contexts, context, self.followers)
            seen = total > 0
            p = np.where(seen, (_found(self.keys, key, self.counts) + followers * p) / np.maximum(total + followers, 1), p)
        return p


def _found(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def differences(data: np.ndarray, at: np.ndarray, accepted: MarkovModel, rejected: MarkovModel) -> np.ndarray:
    """By URL, the mean over its symbols of log2 of accepted over rejected probability."""
    window = _windows(data, at, accepted.order)
    kinds, place = np.unique(window, return_inverse=True)
    ratio = np.log2(accepted.chance(kinds)) - np.log2(rejected.chance(kinds))
    size = np.diff(at) + 1
    return np.bincount(np.repeat(np.arange(len(size)), size), ratio[place], len(size)) / size


@dataclass
class UrlModel:
    accepted: MarkovModel
    rejected: MarkovModel
    slope: float
    offset: float

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -500, 500)))


def _counted(urls: DataFrame, order: int) -> DataFrame:
    """(accept, key, c): windows of all orders in ``urls(url, accept)``."""

    def count(batches):
        for batch in batches:
            side = np.asarray(batch.column(1))
            for mark in (False, True):
                data, places = utf8(batch.column(0).filter(pa.array(side == mark)))
                for _, x, at in slices(data, places):
                    window = _windows(x, at, order)
                    for k in range(order + 1):
                        key, n = np.unique(_of_order(window, k), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([mark] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], names=["accept", "key", "c"])

    return urls.mapInArrow(count, "accept boolean, key long, c long").groupBy("accept", "key").agg(F.sum("c").alias("c"))


def _calibrated(found: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve through smoothed labels, both sides weighing alike.

    ``found(difference, accept)`` stays in tasks: a step of Newton's method reads five sums of it.
    """
    d, accept = F.col("difference"), F.col("accept")
    whole = found.agg(F.count_if(~accept).alias("rejected"), F.count_if(accept).alias("accepted"), F.max(F.abs(d)).alias("largest")).first()
    n = (whole.rejected, whole.accepted)
    if not all(n):
        return 1.0, 0.0
    scale = whole.largest or 1.0
    goal = F.when(accept, (n[1] + 1) / (n[1] + 2)).otherwise(1 / (n[0] + 2))
    weight = F.when(accept, 0.5 / n[1]).otherwise(0.5 / n[0])
    w = np.zeros(2)
    ridge = np.diag([1e-4, 1e-8])
    for _ in range(50):
        x = d / scale
        z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x * float(w[0]) + float(w[1])))
        at = found.select(x.alias("x"), goal.alias("goal"), weight.alias("weight"), (1 / (1 + F.exp(-z))).alias("p"))
        pull, bend = F.col("weight") * (F.col("p") - F.col("goal")), F.col("weight") * F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-9))
        s = at.agg(F.sum(pull * F.col("x")), F.sum(pull), F.sum(bend * F.col("x") * F.col("x")), F.sum(bend * F.col("x")), F.sum(bend)).first()
        step = np.linalg.solve(np.array([[s[2], s[3]], [s[3], s[4]]]) + ridge, np.array([s[0], s[1]]) + ridge @ w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-10:
            break
    return (float(w[0] / scale), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _differences(urls: DataFrame, models: list[MarkovModel]) -> DataFrame:
    """(difference, accept) of ``urls(url, accept)``."""
    held = urls.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            data, places = utf8(batch.column(0))
            parts = [differences(x, at, *held.value) for _, x, at in slices(data, places)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts or [np.zeros(0)])), batch.column(1)], names=["difference", "accept"])

    return urls.mapInArrow(run, "difference double, accept boolean")


def fit_urls(urls: DataFrame, rules: list[Rule], order: int = ORDER, url_column: str = "url") -> UrlModel | None:
    """Models of all URLs that rules accept and reject; None unless there are both.

    Different URLs count once each, whatever their number of rows or their length; one in five
    calibrates. The driver holds the counts of different windows, not the URLs.
    """
    url = F.col(url_column)
    verdict = fitting_rule(rules, host_of_url(url), path_of_url(url))["verdict"]
    labelled = stored(urls.select(url.alias("url"), (verdict == "allow").alias("accept")).where("accept is not null").distinct(), "labelled-urls")
    if len(labelled.select("accept").distinct().collect()) < 2:
        return None
    apart = F.pmod(F.xxhash64("url", F.lit("held")), F.lit(HELD_FOR_CALIBRATION)) == 0
    held = _counted(labelled.where(~apart), order).toArrow()
    side, keys, counts = (np.asarray(held[c]) for c in ("accept", "key", "c"))
    models = [MarkovModel(keys[side == mark].astype(np.int64).view(np.uint64), counts[side == mark], order) for mark in (True, False)]
    return UrlModel(*models, *_calibrated(stored(_differences(labelled.where(apart), models), "url-differences")))


def judge_urls(pages: DataFrame, rules: list[Rule], model: UrlModel | None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, difference, p_allow) of every row.

    The verdict is that of the longest rule that fits, else the model's: ``allow`` where the
    calibrated probability is a half or more. Without a model every other URL is allowed, at a
    half. A null URL has an empty host and path and is scored as an empty one; repeated rows give
    repeated results, and a null id is an id. Other columns do not count.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)
    names = ["difference", "p_allow"]

    def score(batches):
        model = held.value
        for batch in batches:
            data, places = utf8(batch.column(0))
            if model is None:
                found, p = np.zeros(len(batch)), np.full(len(batch), 0.5)
            else:
                found = np.concatenate([differences(x, at, model.accepted, model.rejected) for _, x, at in slices(data, places)] or [np.zeros(0)])
                p = model.probability(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array(p)], names=["url", "page_id", *names])

    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("page_id", pages.schema[id_column].dataType)])
    for name in names:
        schema = schema.add(name, "double")
    scored = pages.select(F.col(url_column).alias("url"), F.col(id_column).alias("page_id")).mapInArrow(score, schema)
    parts = scored.select("page_id", host_of_url(F.col("url")).alias("host"), path_of_url(F.col("url")).alias("path"), *names)
    ruled = parts.withColumn("_rule", fitting_rule(rules, F.col("host"), F.col("path")))
    own = F.when(F.col("p_allow") >= 0.5, "allow").otherwise("block")
    return ruled.select("page_id", "host", "path", F.col("_rule.name").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), *names)


def url_filter(pages: DataFrame, rules: list[Rule], order: int = ORDER) -> DataFrame:
    """Fit on the URLs that rules decide, and judge all."""
    return judge_urls(pages, rules, fit_urls(pages, rules, order))
