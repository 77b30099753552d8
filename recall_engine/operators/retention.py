"""An event log in day folders: old days go as a whole, small files are merged."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.operators.ranges import settled


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def append_days(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends events to the folders of their days (UTC where the session says
    so); a null time goes to a folder of its own, which is never forgotten."""
    events.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The log with ``day``; a filter on it reads those folders alone."""
    return spark.read.parquet(path)


def days_held(spark: SparkSession, path: str) -> dict[datetime.date, tuple[int, int]]:
    """{day: (files, bytes)} from the folders' listing; no file is opened."""
    files, place = _folder(spark, path)
    found = {}
    for status in files.listStatus(place) if files.exists(place) else []:
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("day=2"):
            data = [x.getLen() for x in files.listStatus(status.getPath()) if x.getPath().getName().startswith("part-")]
            found[datetime.date.fromisoformat(name[4:])] = (len(data), sum(data))
    return found


def forget_days(spark: SparkSession, path: str, before: datetime.date) -> list[datetime.date]:
    """Deletes the folders of days before a date, and says which: a step on the
    listing, whatever the number of events."""
    files, _ = _folder(spark, path)
    old = sorted(d for d in days_held(spark, path) if d < before)
    for day in old:
        files.delete(_folder(spark, f"{path}/day={day.isoformat()}")[1], True)
    return old


def merge_days(spark: SparkSession, path: str, most_files: int = 8, file_bytes: int = 128 << 20) -> list[datetime.date]:
    """Rewrites the days that lie in more than ``most_files`` files, and more than
    their bytes need, into files of about ``file_bytes``; says which.  Their rows
    are kept aside until the new files stand in their place.  Appends to those
    days must wait meanwhile."""
    needed = {d: max(1, -(-size // file_bytes)) for d, (n, size) in days_held(spark, path).items() if n > most_files and n > -(-size // file_bytes)}
    if not needed:
        return []
    rows = settled(read_days(spark, path).where(F.col("day").isin(*needed)))
    files_of = F.create_map(*(F.lit(x) for pair in needed.items() for x in pair))
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "day"]), F.try_element_at(files_of, "day"))
    dealt = rows.withColumn("_salt", salt).repartition("day", "_salt").drop("_salt")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return sorted(needed)


def keep_days(events: DataFrame, path: str, checkpoint: str, days: int = 30, ts: str = "ts", most_files: int = 8):
    """A stream of events appended to a log of day folders, of which the last
    ``days`` before the latest event stay; days of many small files are merged.

    A batch that runs again after a failure would append twice, so each batch's
    rows carry its number, and rows of that number are taken out first."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files, place = _folder(spark, path)
        if files.exists(place) and batch_id and not (again := read_days(spark, path).where(F.col("batch") == batch_id)).isEmpty():
            touched = [r["day"] for r in again.select("day").distinct().collect()]
            rest = settled(read_days(spark, path).where(F.col("day").isin(*touched) & (F.col("batch") != batch_id)))
            for day in touched:
                files.delete(_folder(spark, f"{path}/day={day.isoformat()}")[1], True)
            rest.write.mode("append").partitionBy("day").parquet(path)
        append_days(batch.withColumn("batch", F.lit(batch_id)), path, ts)
        if held := days_held(spark, path):
            forget_days(spark, path, max(held) - datetime.timedelta(days=days))
        merge_days(spark, path, most_files)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
