"""Items tried again: timers, ends, repeats, and restarts from the checkpoint."""

from __future__ import annotations

import pytest

from skysieve.streaming import retry

EVENTS = "item string, outcome string, at timestamp"


@pytest.fixture
def stream(spark, tmp_path):
    """Adds events and runs the query once from its checkpoint; gives the rows of that run. `again` repeats the last batch."""

    def put(*events):
        rows = spark.createDataFrame([(i, o, None if t is None else f"2026-01-01 00:{t}") for i, o, t in events], "item string, outcome string, t string")
        rows.selectExpr("item", "outcome", "CAST(t AS TIMESTAMP) AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(fail=False):
        out = []

        def each(batch, number):
            out.extend((r["item"], r["status"], r["attempts"], r["at"].strftime("%M:%S")) for r in batch.collect())
            if fail:
                raise RuntimeError("the sink fails")

        found = retry.attempts(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), delay=60, most=3)
        query = found.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        if fail:
            with pytest.raises(Exception, match="the sink fails"):
                query.awaitTermination()
        else:
            query.awaitTermination()
        return sorted(out)

    return put, run


def test_lives_of_items(stream):
    put, run = stream
    put(("a", "new", "00:00"), ("b", "new", "00:01"), ("a", "new", "00:02"), (None, "new", "00:02"), ("c", "huh", "00:02"), ("c", "new", None))
    assert run() == [("a", "due", 0, "00:00"), ("b", "due", 0, "00:01")]
    put(("a", "failed", "00:10"), ("b", "ok", "00:11"), ("b", "failed", "00:12"), ("b", "new", "00:13"))
    assert run(fail=True) == run() == [("b", "done", 1, "00:11")]  # a batch that runs again gives the same
    put(("z", "new", "01:05"))
    assert run() == [("z", "due", 0, "01:05")]  # a is due at 01:10 only
    put(("z", "ok", "01:20"), ("b", "new", "01:21"), ("b", "failed", "01:22"))
    assert run() == [("a", "due", 1, "01:10"), ("z", "done", 1, "01:20")]
    put(("a", "failed", "01:30"), ("y", "new", "03:29"))
    assert run() == [("y", "due", 0, "03:29")]  # twice the delay
    put(("a", "failed", "01:30"), ("y", "ok", "03:40"))
    assert run() == [("a", "due", 2, "03:30"), ("y", "done", 1, "03:40")]
    put(("a", "failed", "03:50"), ("x", "new", "10:00"))
    assert run() == [("a", "given_up", 3, "03:50"), ("x", "due", 0, "10:00")]
    put(("a", "new", "10:01"), ("w", "new", "20:00"))
    assert run() == [("w", "due", 0, "20:00")]


def test_outcomes_at_one_time():
    assert retry.applied("", 0, "new", 3) == ("due", 0) and retry.applied("due", 0, "ok", 3) == ("done", 1)
    assert retry.applied("due", 2, "failed", 3) == ("given_up", 3) and retry.applied("done", 1, "failed", 3) == ("done", 1)
