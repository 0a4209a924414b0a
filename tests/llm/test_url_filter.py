"""The URL filter against rules tried one by one and models counted in dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfmark.llm.url_filter import Rule, fit_urls, judge_urls, url_filter

RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]
SCHEMA = "rule int, page_id long, url string, host int, difference int"


def frame_of(spark, urls):
    return spark.createDataFrame([(0, i, u, 1, 2) for i, u in enumerate(urls)], SCHEMA).repartition(3)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = rest[: min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])]
    tail = rest[len(host) :]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


class PlainModel:
    """Dictionaries of what follows each context."""

    def __init__(self, urls, order):
        self.order, self.after = order, defaultdict(Counter)
        for url in urls:
            s = [257] * order + [b + 1 for b in url.encode()] + [0]
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.after[tuple(s[i - k : i])][s[i]] += 1

    def chance(self, context, symbol):
        lower = self.chance(context[1:], symbol) if context else 1 / 257
        seen = self.after.get(tuple(context))
        return (seen[symbol] + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    def length(self, url):
        s = [257] * self.order + [b + 1 for b in (url or "").encode()] + [0]
        return sum(math.log2(self.chance(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


def made(rng, n):
    words = ["news", "shop", "pills", "bets", "wiki", "blog", "é"]
    return [
        f"http{rng.choice(['', 's'])}://{rng.choice(['www.', '', 'M.'])}{rng.choice(words)}.example.{rng.choice(['org', 'com', 'net'])}"
        f"/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(2000)}{rng.choice(['', '?a=/b#c', '#top', '/', '.html'])}" for _ in range(n)]


ODD = [None, "", "x", "://", "http://", "http://ORG", "http://org/", "http://a.org?x", "http://xorg/en/1", "ftp://EXAMPLE.org/en/12", "http://example.org/en/2",
       "a://b://com/fr/", "http://www.com/fr", "http://com/de/#", "http://e.org/\n?", "http://a.b.example.org/es/x?y", "/path://org/x", "http://a.org/" + "y" * 300_000]


def test_hosts_paths_and_rules(spark):
    urls = ODD + made(random.Random(1), 200)
    rows = url_filter(frame_of(spark, urls + urls[:5]), RULES).collect()
    assert len(rows) == len(urls) + 5
    for r in rows:
        url = (urls + urls[:5])[r.page_id]
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == (rule.verdict if rule else "allow" if r.p_allow >= 0.5 else "block")


@pytest.mark.parametrize("order", [0, 2, 5])
def test_models_agree_with_plain_counts(spark, order):
    import shelfmark.llm.url_filter as U

    urls = made(random.Random(2), 300) + ODD[:-1]
    frame = frame_of(spark, urls + urls)
    labelled = {u: plain_rule(*plain_parts(u)) for u in urls if u}
    labelled = {u: r.verdict == "allow" for u, r in labelled.items() if r}
    # which of the labelled URLs calibrate is told by the hash alone
    from pyspark.sql import functions as F

    known = spark.createDataFrame([(u,) for u in labelled], "url string")
    held = {r.url for r in known.where(F.pmod(F.xxhash64("url", F.lit("held")), F.lit(U.HELD_FOR_CALIBRATION)) == 0).collect()}
    sides = [PlainModel([u for u, a in labelled.items() if a == mark and u not in held], order) for mark in (True, False)]
    model = fit_urls(frame, RULES, order=order)
    for r in judge_urls(frame, RULES, model).collect():
        url = (urls + urls)[r.page_id]
        expected = (sides[0].length(url) - sides[1].length(url)) / (len((url or "").encode()) + 1)
        assert r.difference == pytest.approx(expected, abs=1e-9)
        assert r.p_allow == pytest.approx(1 / (1 + math.exp(-(model.slope * expected + model.offset))), abs=1e-9)
    # the curve is where no small step lowers the loss of the held URLs
    x = np.array([(sides[0].length(u) - sides[1].length(u)) / (len(u.encode()) + 1) for u in held])
    y = np.array([labelled[u] for u in held])
    if y.any() and not y.all() and (model.slope, model.offset) != (1.0, 0.0):
        goal = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
        scale = np.abs(x).max()

        def loss(a, b):
            p = 1 / (1 + np.exp(-(a * x + b)))
            part = -(goal * np.log(p) + (1 - goal) * np.log(1 - p))
            return 0.5 * part[y].mean() + 0.5 * part[~y].mean() + 0.5e-4 * (a * scale) ** 2 + 0.5e-8 * b**2

        best = loss(model.slope, model.offset)
        assert all(best <= loss(model.slope * (1 + d), model.offset + e) + 1e-12 for d in (-1e-3, 0, 1e-3) for e in (-1e-3, 0, 1e-3))


def test_sides_are_told_apart(spark):
    """URLs without a rule that look like rejected ones are blocked."""
    rng = random.Random(3)
    good = [f"http://{rng.choice(['news', 'wiki', 'paper'])}{rng.randrange(99)}.net/article/{rng.randrange(9999)}" for _ in range(600)]
    bad = [f"http://{rng.choice(['casino', 'pills', 'xbets'])}{rng.randrange(99)}.net/win/{rng.randrange(9999)}" for _ in range(600)]
    rules = [Rule("allow", "good.net", "/"), Rule("block", "bad.net", "/")]
    ruled = [u.replace(".net", ".good.net") for u in good[:300]] + [u.replace(".net", ".bad.net") for u in bad[:300]]
    rows = {r.page_id: r for r in url_filter(frame_of(spark, ruled + good[300:] + bad[300:]), rules).collect()}
    right = [rows[600 + i].verdict == ("allow" if i < 300 else "block") for i in range(600)]
    assert sum(right) / 600 > 0.97


def test_without_examples(spark):
    for urls in ([], [None], ["http://a.net/x"], ["http://a.org/x", "http://b.net/"], ["http://a.com/de/", "http://b.net/"]):
        rows = url_filter(frame_of(spark, urls), RULES).collect()
        assert len(rows) == len(urls) and all(r.rule or r.verdict == "allow" for r in rows)
