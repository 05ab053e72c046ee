"""A job from created to collected, expiry and replays, over micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from trendloom.streaming import compliance_job

AT = dt.datetime(2026, 1, 1)


def test_job_over_ticks(spark, tmp_path):
    tick = lambda job, n, minutes, answer=None: (job, n, AT + dt.timedelta(minutes=minutes), answer)
    batches = [
        [tick("a", 1, 0), tick("b", 1, 0, "accepted"), tick("c", 1, 0, "rejected"), tick("d", 1, 0)],
        [tick("a", 2, 10, "accepted"), tick("b", 2, 10, "in_progress"), tick("c", 2, 10, "accepted"), tick("d", 2, 20)],
        [tick("a", 2, 10, "accepted"), tick("a", 3, 20), tick("b", 3, 50), tick("c", 3, 20, "failed"), tick("d", 3, 30)],  # a's tick 2 comes again
        [tick("a", 4, 30, "complete"), tick("a", 5, 40), tick("b", 4, 60)],
    ]
    schema = "job string, tick long, at timestamp, answer string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
        q = compliance_job.steps(spark.readStream.schema(schema).parquet(str(tmp_path / "ticks"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("job", F.col("tick")).collect():
        got.setdefault(r.job, []).append((r.tick, r.step, r.state))
    assert got == {
        "a": [(1, "create", "created"), (2, "upload", "in_progress"), (3, "poll", "in_progress"), (4, "collect", "collected"), (5, "create", "created")],
        "b": [(1, "create", "in_progress"), (2, "poll", "in_progress"), (3, "expire", "expired"), (4, "create", "created")],
        "c": [(1, "create", "failed"), (2, "create", "in_progress"), (3, "poll", "failed")],
        "d": [(1, "create", "created"), (2, "expire", "expired"), (3, "create", "created")],
    }
