"""A chunk index that is appended to: deltas, tombstones and a compaction.

A store is a folder of generations.  A generation holds chunks, in folders of
their project and of the run that wrote them, and a log of files: a row for each
file that a run wrote or removed.  Rows of the log are written after a run's
chunks and make them count, so a run that broke off leaves nothing that is read.
An update writes what changed; what it replaced is left out on reading, and a
compaction copies what counts into a new generation.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.operators.embedding import Embedder
from recall_engine.operators.indexing import FILE_KEY, index_rows

LOG = "project_id string, file_path string, version long, run string, file_hash string, chunks long, deleted boolean"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the generations whose log is whole, ascending."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    numbers = [int(x.getPath().getName()[4:]) for x in files.listStatus(place) if x.getPath().getName().startswith("gen-")]
    return sorted(n for n in numbers if files.exists(_files(spark, f"{path}/gen-{n}/files/_SUCCESS")[1]))


def _log(spark: SparkSession, path: str, generation: int) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{path}/gen-{generation}/files")


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(LOG) the last row of each file that is in the store; none without a store."""
    known = generations(spark, path)
    if not known:
        return spark.createDataFrame([], LOG)
    fields = [x.split()[0] for x in LOG.split(", ")][2:]
    last = _log(spark, path, known[-1]).groupBy(*FILE_KEY).agg(F.max_by(F.struct(*fields), "version").alias("x"))
    return last.select(*FILE_KEY, "x.*").where("NOT deleted")


def read_store(spark: SparkSession, path: str, project_id: str | None = None) -> DataFrame:
    """The chunks that count, as a full rebuild would give them; an error without
    a store.  A project's folders alone are read where one is named.

    What no longer counts is joined away by file and run: what was replaced since
    the last compaction, whatever the size of the index."""
    known = generations(spark, path)
    if not known:
        raise FileNotFoundError(path)
    log = _log(spark, path, known[-1])
    log = log if project_id is None else log.where(F.col("project_id") == project_id)
    chunks = spark.read.option("inferPartitionColumns", False).option("mergeSchema", False).parquet(f"{path}/gen-{known[-1]}/chunks").withColumns({c: F.col(c).cast("string") for c in ("project_id", "run")})
    chunks = chunks if project_id is None else chunks.where(F.col("project_id") == project_id)
    last = log.groupBy(*FILE_KEY).agg(F.max_by(F.when(~F.col("deleted"), F.col("run")).otherwise(""), "version").alias("_run"))
    dead = log.where("NOT deleted").join(last, FILE_KEY).where("run <> _run").select(*FILE_KEY, "run")
    runs = F.broadcast(log.select("run").distinct())  # one an update since the last compaction
    return chunks.join(runs, "run", "left_semi").join(dead, [*FILE_KEY, "run"], "left_anti").drop("run")


def update_store(spark: SparkSession, files: DataFrame, path: str, embedder: Embedder, now: Column, *, removed: DataFrame | None = None, force: bool = False, whole: bool = False) -> DataFrame:
    """Brings a store up to date; (project_id, files, chunks, removed) of the run.

    files: (project_id, path, language, hash, content), one row each; those whose
    hash is stored are skipped unless ``force``.  removed: (project_id, path) of
    files that leave; with ``whole`` all stored files of the projects in
    ``files`` that aren't among them do.  A first update creates the store.
    """
    known = generations(spark, path)
    generation = known[-1] if known else 0
    held = stored_files(spark, path).select("project_id", F.col("file_path").alias("path"), F.col("file_hash").alias("hash"))
    changed = files if force else files.join(held, ["project_id", "path", "hash"], "left_anti")
    version = 1 + ((_log(spark, path, generation).agg(F.max("version")).first()[0] or 0) if known else 0)
    run = uuid.uuid4().hex
    base = f"{path}/gen-{generation}"
    index_rows(changed, embedder, now).withColumn("run", F.lit(run)).write.mode("append").partitionBy("project_id", "run").parquet(f"{base}/chunks")
    schema = spark.read.option("inferPartitionColumns", False).parquet(f"{base}/chunks").schema
    written = spark.read.schema(schema).parquet(f"{base}/chunks").where(F.col("run") == run)
    rows = written.groupBy(*FILE_KEY).agg(F.min("file_hash").alias("file_hash"), F.count(F.lit(1)).alias("chunks")).withColumn("deleted", F.lit(False))
    gone = held.limit(0) if removed is None else held.join(removed.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")
    if whole:
        gone = gone.unionByName(held.join(files.select("project_id").distinct(), "project_id", "left_semi").join(files.select("project_id", "path"), ["project_id", "path"], "left_anti")).distinct()
    gone = gone.join(changed.select("project_id", "path"), ["project_id", "path"], "left_anti")
    rows = rows.unionByName(gone.select("project_id", F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.lit(0).cast("long").alias("chunks"), F.lit(True).alias("deleted")))
    fields = [x.split()[0] for x in LOG.split(", ")]
    rows.withColumns({"version": F.lit(version).cast("long"), "run": F.lit(run)}).select(*fields).write.mode("append").parquet(f"{base}/files")
    mine = _log(spark, path, generation).where(F.col("run") == run)
    return mine.groupBy("project_id").agg(F.count_if(~F.col("deleted")).alias("files"), F.sum("chunks").alias("chunks"), F.count_if("deleted").alias("removed"))


def dead_share(spark: SparkSession, path: str) -> float:
    """Which share of the chunks on disk no longer counts."""
    known = generations(spark, path)
    if not known:
        return 0.0
    whole = _log(spark, path, known[-1]).agg(F.sum("chunks")).first()[0] or 0
    live = stored_files(spark, path).agg(F.sum("chunks")).first()[0] or 0
    return 1 - live / whole if whole else 0.0


def compact_store(spark: SparkSession, path: str, least_dead: float = 0.3) -> bool:
    """Copies what counts into a new generation once ``least_dead`` of the chunks
    don't; whether it did.  The generation before stays for readers that began
    on it, older ones and those that broke off are deleted."""
    known = generations(spark, path)
    if not known or dead_share(spark, path) < least_dead:
        return False
    new, run = known[-1] + 1, uuid.uuid4().hex
    files, _ = _files(spark, path)
    files.delete(_files(spark, f"{path}/gen-{new}")[1], True)
    read_store(spark, path).withColumn("run", F.lit(run)).repartition("project_id", F.pmod(F.xxhash64("file_path"), F.lit(16))).write.partitionBy("project_id", "run").parquet(f"{path}/gen-{new}/chunks")
    stored_files(spark, path).withColumn("run", F.lit(run)).select(*[x.split()[0] for x in LOG.split(", ")]).write.parquet(f"{path}/gen-{new}/files")
    for status in files.listStatus(_files(spark, path)[1]):
        name = status.getPath().getName()
        if name.startswith("gen-") and int(name[4:]) < known[-1]:
            files.delete(status.getPath(), True)
    return True


def bytes_on_disk(spark: SparkSession, path: str) -> int:
    """Bytes below a folder; 0 without one."""
    files, place = _files(spark, path)
    return files.getContentSummary(place).getLength() if files.exists(place) else 0
