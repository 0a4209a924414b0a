"""The URL models count every labelled URL."""

from shelfmark.llm.url_filter import Rule, fit_urls


def test_every_labelled_url_is_counted(spark):
    """More bytes than any sample once held, and one URL of over 8 KiB."""
    rules = [Rule("allow", "a.org", "/"), Rule("block", "b.org", "/")]
    long = "http://a.org/" + "z" * 9000
    urls = [f"http://{side}.org/{'x' * 80}/{i}" for side in "ab" for i in range(8000)] + [long] * 2
    frame = spark.createDataFrame([(u,) for u in urls], "url string").repartition(4)
    from pyspark.sql import functions as F

    counted = {r.url for r in frame.distinct().where(F.pmod(F.xxhash64("url", F.lit("held")), F.lit(5)) != 0).collect()}
    model = fit_urls(frame, rules, order=1)
    for m, host in ((model.accepted, "//a."), (model.rejected, "//b.")):
        # the empty context is followed by every symbol of every URL, its end too
        assert m.totals[m.contexts == 0].sum() == sum(len(u) + 1 for u in counted if host in u)
