"""Logs in day folders: forgetting, merging, and the stream that does both."""

import datetime

from pyspark.sql import functions as F

from recall_engine.operators import retention

SF = "/root/testdata/sf0.001"


def test_days_are_forgotten_and_merged(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert retention.days_held(spark, path) == {} and retention.forget_days(spark, path, datetime.date(2030, 1, 1)) == []
    for k in range(3):
        retention.append_days(events.where(F.col("event_id") % 3 == k).repartition(4), path)
    held = retention.days_held(spark, path)
    assert max(n for n, _ in held.values()) > 8
    line = sorted(held)[len(held) // 2]
    assert retention.forget_days(spark, path, line) == [d for d in sorted(held) if d < line]
    assert not any((tmp_path / "log" / f"day={d}").exists() for d in held if d < line)
    merged = retention.merge_days(spark, path, 2)
    assert merged and all(n == 1 for d, (n, _) in retention.days_held(spark, path).items() if d in merged)
    assert retention.merge_days(spark, path, 2) == []
    kept = sorted(tuple(r) for r in retention.read_days(spark, path).select("event_id", "event_type").collect())
    assert kept == sorted(tuple(r) for r in events.where(F.to_date("ts") >= F.lit(line)).select("event_id", "event_type").collect())


def test_null_times_stay(spark, tmp_path):
    path = str(tmp_path / "log")
    retention.append_days(spark.createDataFrame([(1, None), (2, datetime.datetime(2024, 1, 1))], "i int, ts timestamp"), path)
    retention.forget_days(spark, path, datetime.date(2025, 1, 1))
    assert [r.i for r in retention.read_days(spark, path).collect()] == [1]


def test_stream_keeps_the_last_days(spark, tmp_path):
    at, path = str(tmp_path / "in"), str(tmp_path / "log")
    shape = "event_id long, ts timestamp"
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    for batch in ([(1, day(0)), (2, day(9))], [(3, day(20)), (4, day(9))]):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(at)
        retention.keep_days(spark.readStream.schema(shape).parquet(at), path, str(tmp_path / "c"), days=11).trigger(availableNow=True).start().awaitTermination(100)
    assert sorted(r.event_id for r in retention.read_days(spark, path).collect()) == [2, 3, 4]
