"""What answers of the repository lookup mean."""

from pyspark.sql import functions as F

from trendloom.operators import enrichment


def test_outcomes(spark):
    cases = {
        (200, None, 5): "found", (304, None, 5): "unchanged", (301, None, 5): "not_found", (404, None, 5): "not_found", (451, None, None): "not_found", (403, 60, 5): "rate_limited", (403, None, 0): "rate_limited",
        (403, None, 5): "private", (403, None, None): "private", (429, 1, None): "rate_limited", (500, None, 5): "failed", (None, None, None): "failed", (418, None, 5): "failed",
    }
    df = spark.createDataFrame(list(cases), "s int, r int, n int").coalesce(1)
    assert [r[0] for r in df.select(enrichment.outcome(F.col("s"), F.col("r"), F.col("n"))).collect()] == list(cases.values())
    asked = enrichment.requests(spark.createDataFrame([(1, "a", "b", '"x"'), (2, "a", "c", ""), (3, "a", "d", None)], "id int, owner string, name string, etag string")).orderBy("id").collect()
    assert [tuple(r) for r in asked] == [(1, "/repos/a/b", '"x"'), (2, "/repos/a/c", None), (3, "/repos/a/d", None)]
