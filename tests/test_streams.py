"""Streams in two runs: a duplicate, a late row, a restart, and nothing yet."""

import datetime as dt

import pytest

from skyloom.streaming import events

SCHEMA = "event_id long, user_id long, ts timestamp, value double"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_duplicates_and_late_rows_go_over_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    stream = lambda: events.deduplicated(spark.readStream.schema(SCHEMA).parquet(source))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert events.run_once(stream(), folder, "append").isEmpty()
    spark.createDataFrame([(1, 1, at(0), 1.0), (1, 1, at(0), 1.0), (2, 1, at(5), 2.0), (3, 2, at(5.5), 3.0)], SCHEMA).write.mode("append").parquet(source)
    first = events.run_once(stream(), folder, "append")
    assert sorted(r["event_id"] for r in first.collect()) == [1, 2, 3]
    # 3 again within the hour, 4 later than the watermark (4:30), 5 new
    spark.createDataFrame([(3, 2, at(5.4), 3.0), (4, 2, at(2), 4.0), (5, 2, at(6), 5.0)], SCHEMA).write.mode("append").parquet(source)
    again = events.run_once(stream(), folder, "append")
    assert sorted(r["event_id"] for r in again.collect()) == [1, 2, 3, 5]
    assert events.run_once(stream(), folder, "append").count() == 4


def test_moments_go_on_after_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    schema = f"{SCHEMA}, error double"
    stream = lambda: events.running_moments(spark.readStream.schema(schema).parquet(source))
    spark.createDataFrame([(1, 1, at(0), 1.0, 1.0), (2, 1, at(1), 3.0, 0.5), (3, 2, at(1), 7.0, 0.0), (4, 2, at(1), None, 1.0)], schema).write.parquet(source)
    events.run_once(stream(), folder)
    spark.createDataFrame([(5, 1, at(2), 5.0, 1.0), (6, 2, at(2), 2.0, 2.0)], schema).write.mode("append").parquet(source)
    got = {r["user_id"]: (r["n"], r["mean"], r["variance"]) for r in events.run_once(stream(), folder).collect()}
    w, x = [1, 4, 1], [1, 3, 5]
    mean = sum(a * b for a, b in zip(w, x, strict=True)) / 6
    assert got[1] == pytest.approx((3, mean, sum(a * (b - mean) ** 2 for a, b in zip(w, x, strict=True)) / 6))
    assert got[2] == pytest.approx((1, 2.0, 0.0))


def test_sessions_join_over_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    stream = lambda: events.sessions(spark.readStream.schema(SCHEMA).parquet(source), gap="2 hours")
    spark.createDataFrame([(1, 1, at(0), 1.0), (2, 1, at(1), 1.0), (3, 1, at(4), 1.0)], SCHEMA).write.parquet(source)
    events.run_once(stream(), folder)
    spark.createDataFrame([(4, 1, at(2.5), 1.0), (5, 2, at(4), 1.0)], SCHEMA).write.mode("append").parquet(source)
    got = sorted((r["user_id"], r["start"], r["stop"], r["n"]) for r in events.run_once(stream(), folder).collect())
    assert got == [(1, at(0), at(4), 4), (2, at(4), at(4), 1)]
