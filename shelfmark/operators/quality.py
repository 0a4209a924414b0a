"""Judging responses, planning retries, and what a host's attempts say about the host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Status classes and limits.
PERMANENT_STATUSES = [400, 401, 404, 410, 451]
THROTTLE_STATUSES = [429]
FINGERPRINT_STATUSES = [403, 406, 503]
MIN_CREDIBLE_HTML = 200
SNIFFED_CHARS = 4000
RETRIES = 3
IMAGE_RETRIES = 3
IMAGE_BACKOFF = 2.0
BACKOFF_CAP, RETRY_AFTER_CAP = 30.0, 60.0
EXHAUSTED_AFTER = 3
PROBE_LIMIT = 4
# Texts of interstitial pages.
CHALLENGE_MARKERS = [
    "just a moment...", "checking your browser", "enable javascript and cookies to continue",
    "cf-browser-verification", "challenge-platform", "_incapsula_resource", "ddos-guard",
]


def header(headers: Column, name: str) -> Column:
    """A header's value whatever the case of its name."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


def looks_like_challenge(body: Column, headers: Column | None = None) -> Column:
    """True for a page that stands in for the content: by header, or by text near its start."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, SNIFFED_CHARS))
    marked = F.lit(False)
    for marker in CHALLENGE_MARKERS:
        marked = marked | head.contains(marker)
    if headers is None:
        return marked
    return (F.lower(header(headers, "cf-mitigated")) == "challenge") | marked


def classify_response(responses: DataFrame, binary: bool = False) -> DataFrame:
    """Add ``outcome`` (ok, permanent, fingerprint, throttled, transient) and ``reason``.

    A NULL status is an attempt without a response; its reason is taken from ``error`` when the
    table has that column.
    """
    status = F.col("status")
    size = F.length(F.coalesce(F.col("body"), F.lit("")))
    failed = F.coalesce(F.col("error"), F.lit("unknown error")) if "error" in responses.columns else F.lit("unknown error")

    def verdict(outcome, reason):
        return F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"))

    nothing = F.lit(None).cast("string")
    empty = verdict("transient", F.lit("empty response body"))
    answered = F.when(size == 0, empty).otherwise(verdict("ok", nothing))
    if not binary:
        is_html = F.lower(header(F.col("headers"), "content-type")).contains("html")
        short = F.concat(F.lit("suspiciously short HTML ("), size.cast("string"), F.lit(" bytes)"))
        answered = (
            F.when(
                looks_like_challenge(F.col("body"), F.col("headers")),
                verdict("fingerprint", F.lit("bot challenge page")),
            )
            .when(size == 0, empty)
            .when(is_html & (size < MIN_CREDIBLE_HTML), verdict("transient", short))
            .otherwise(verdict("ok", nothing))
        )
    reason = F.concat(F.lit("HTTP "), status.cast("string"))
    result = (
        F.when(status.isNull(), verdict("transient", failed))
        .when(status == 200, answered)
        .when(status.isin(PERMANENT_STATUSES), verdict("permanent", reason))
        .when(status.isin(THROTTLE_STATUSES), verdict("throttled", reason))
        .when(status.isin(FINGERPRINT_STATUSES), verdict("fingerprint", reason))
        .otherwise(verdict("transient", reason))
    )
    return responses.withColumn("_v", result).select(*responses.columns, "_v.outcome", "_v.reason")


def retry_delay(attempt: Column, retry_after: Column, jitter: Column | None = None) -> Column:
    """Seconds before retry number ``attempt`` (0-based). A usable Retry-After wins."""
    jitter = F.rand() if jitter is None else jitter
    stated = retry_after.try_cast("double")
    delay = F.pow(F.lit(2.0), F.least(attempt, F.lit(10)))
    own = F.when(delay >= BACKOFF_CAP, F.lit(BACKOFF_CAP)).otherwise(delay + jitter)
    return F.when(stated.isNotNull(), F.least(stated, F.lit(RETRY_AFTER_CAP))).otherwise(own)


def retry_plan(attempts: DataFrame, order: list, retries: int = RETRIES, jitter: Column | None = None) -> DataFrame:
    """What to do next per URL, from ``attempts(url, outcome, retry_after, ts, ...)``.

    ``done``, ``drop`` (permanent), ``blocked`` (never retried here), ``retry`` at
    ``next_attempt_at``, or ``give_up`` once ``retries`` attempts are used.
    """
    state = attempts.groupBy("url").agg(
        F.max_by(F.struct("outcome", "retry_after", "ts"), F.struct(*order)).alias("last"),
        F.count(F.lit(1)).alias("attempts"),
    )
    action = (
        F.when(F.col("last.outcome") == "ok", "done")
        .when(F.col("last.outcome") == "permanent", "drop")
        .when(F.col("last.outcome") == "fingerprint", "blocked")
        .when(F.col("attempts") >= retries, "give_up")
        .otherwise("retry")
    )
    stated = F.when(F.col("last.outcome") == "throttled", F.col("last.retry_after"))
    delay = F.when(
        F.col("action") == "retry", retry_delay(F.col("attempts") - 1, stated, jitter)
    )
    return (
        state.withColumn("action", action)
        .withColumn("delay", delay)
        .select(
            "url", "attempts", F.col("last.outcome").alias("last_outcome"), "action", "delay",
            F.timestamp_micros(
                F.unix_micros(F.col("last.ts").cast("timestamp")) + (F.col("delay") * 1e6).cast("long")
            ).alias("next_attempt_at"),
        )
    )


def image_retry_plan(attempts: DataFrame, order: list) -> DataFrame:
    """The same for image downloads: one try and three more, waiting a little longer each time."""
    return retry_plan(attempts, order, retries=1 + IMAGE_RETRIES).withColumn(
        "delay", F.when(F.col("action") == "retry", F.col("attempts") * F.lit(IMAGE_BACKOFF))
    ).drop("next_attempt_at")


def host_block_summary(attempts: DataFrame, order: list) -> DataFrame:
    """Per host of ``attempts(host, outcome, profile, ...)``: blocked failures since the last
    success, whether that exhausts the host, and the profile that last worked.

    Two aggregations with map-side combine; the one row per host of the first is joined to the
    attempts, and a hot host's attempts can still be split over tasks.
    """
    place = F.struct(*order)
    ok = F.col("outcome") == "ok"
    wins = attempts.groupBy("host").agg(
        F.max(F.when(ok, place)).alias("_won"),
        F.max_by(F.when(ok, F.col("profile")), F.when(ok, place)).alias("profile"),
    )
    blocked = attempts.where(F.col("outcome") == "fingerprint").select("host", place.alias("_at"))
    since = (
        blocked.join(wins.where("_won is not null").select("host", "_won"), "host", "left")
        .where(F.col("_won").isNull() | (F.col("_at") > F.col("_won")))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    n = F.coalesce("_n", F.lit(0))
    return wins.join(since, "host", "left").select(
        "host", n.alias("blocked"), (n >= EXHAUSTED_AFTER).alias("exhausted"), "profile"
    )


def price_context(observed: DataFrame, order: list, limit: int = PROBE_LIMIT) -> DataFrame:
    """Per host, what its variant observations say about asking with a parameter.

    ``observed(host, url, param, priced, ...)``: one row per product and parameter tried, NULL
    for the plain page. The first parameter that gave a price is the host's. ``state`` is
    ``known``; ``settled`` when plain pages carry prices, or when ``limit`` products stayed
    without one; else ``probing``. ``misses`` counts the products no parameter priced.
    """
    place = F.struct(*order)
    won = F.col("priced") & F.col("param").isNotNull()
    product = observed.groupBy("host", "url").agg(
        F.min_by(F.when(won, F.col("param")), F.when(won, place)).alias("_param"),
        F.min(F.when(won, place)).alias("_at"),
        F.bool_or(F.col("priced") & F.col("param").isNull()).alias("_plain"),
    )
    lost = F.col("_param").isNull() & ~F.col("_plain")
    hosts = product.groupBy("host").agg(
        F.min_by("_param", "_at").alias("preferred_param"),
        F.bool_or("_plain").alias("_plain"),
        F.count_if(lost).alias("misses"),
    )
    state = (
        F.when(F.col("preferred_param").isNotNull(), "known")
        .when(F.col("_plain") | (F.col("misses") >= limit), "settled")
        .otherwise("probing")
    )
    return hosts.select("host", "preferred_param", "misses", state.alias("state"))
