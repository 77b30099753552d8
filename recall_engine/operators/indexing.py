"""The chunk index: a Parquet table partitioned by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.operators.code_chunks import code_chunks
from recall_engine.operators.embedding import Embedder, embed_texts
from recall_engine.operators.vectors import top_k

FILE_KEY = ["project_id", "file_path"]


def indexed_files(index: DataFrame) -> DataFrame:
    """(project_id, path, hash, chunks): what the index holds of each file."""
    return index.groupBy("project_id", F.col("file_path").alias("path")).agg(F.min_by("file_hash", F.struct("timestamp", "id")).alias("hash"), F.count(F.lit(1)).alias("chunks"))


def changed_files(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Files that the index lacks or holds by another hash; all with ``force``."""
    if force:
        return files
    return files.join(indexed_files(index).select("project_id", "path", "hash"), ["project_id", "path", "hash"], "left_anti")


def index_rows(files: DataFrame, embedder: Embedder, now: Column) -> DataFrame:
    """Chunk rows of files, with vectors."""
    return embed_texts(code_chunks(files), embedder).withColumn("timestamp", now)


def replace_files(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with the given files' chunks in place of their old ones."""
    return index.join(rows.select(*FILE_KEY).distinct(), FILE_KEY, "left_anti").unionByName(rows)


def write_index(rows: DataFrame, path: str) -> None:
    """Writes whole projects: those in ``rows`` are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def read_index(spark: SparkSession, path: str, project_id: str | None = None) -> DataFrame:
    rows = spark.read.option("inferPartitionColumns", False).parquet(path).withColumn("project_id", F.col("project_id").cast("string"))
    return rows if project_id is None else rows.where(F.col("project_id") == project_id)


def index_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def without_chunks(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index less the chunks of these ids (id)."""
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def without_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index less these files (project_id, file_path)."""
    return index.join(files.select(*FILE_KEY).distinct(), FILE_KEY, "left_anti")


def clear_index(spark: SparkSession, path: str, project_id: str | None = None) -> None:
    """Deletes an index, or one project of it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path if project_id is None else f"{path}/project_id={project_id}")
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def update_index(spark: SparkSession, files: DataFrame, path: str, embedder: Embedder, now: Column, staging: str, force: bool = False, whole: bool = False) -> DataFrame:
    """Brings an index up to date and returns (project_id, files, chunks) of the run.

    Rows go to ``staging`` first, which is deleted at the end: the projects'
    partitions are only replaced once everything is computed.  That rewrites
    whole projects; operators.store writes what changed.  An index that isn't there yet is created.
    whole: ``files`` are all files of their projects, so others leave the index.
    """
    if not index_exists(spark, path):
        fresh = index_rows(files, embedder, now)
        write_index(fresh, path)
        fresh = read_index(spark, path).join(files.select("project_id").distinct(), "project_id", "left_semi")
        return fresh.groupBy("project_id").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))
    index = read_index(spark, path)
    fresh = index_rows(changed_files(files, index, force), embedder, now)
    fresh.write.parquet(f"{staging}/fresh")
    fresh = spark.read.parquet(f"{staging}/fresh")
    touched = (files if whole else fresh).select("project_id").distinct()
    kept = index.join(touched, "project_id", "left_semi")
    if whole:
        kept = kept.join(files.select("project_id", F.col("path").alias("file_path")).distinct(), FILE_KEY, "left_semi")
    replace_files(kept, fresh.select(*index.columns)).write.parquet(f"{staging}/all")
    write_index(spark.read.parquet(f"{staging}/all"), path)
    counts = fresh.groupBy("project_id").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"))
    rows = counts.collect()  # one a project of the run
    clear_index(spark, staging)
    return spark.createDataFrame(rows, counts.schema)


def search(index: DataFrame, text: str, embedder: Embedder, k: int = 10, min_score: float = 0.4, *, file: str | None = None, language: str | None = None, chunk_type: str | None = None) -> DataFrame:
    """The chunks nearest to a text, best first; filters hold before the ranking."""
    if not text.strip():
        raise ValueError("blank query")
    where = F.lit(True)
    if file:
        where = where & F.col("file_path").contains(file)
    if language:
        where = where & (F.col("language") == language)
    if chunk_type:
        where = where & (F.col("chunk_type") == chunk_type)
    rows = index.withColumns({"embedding": F.col("vector"), "vec_id": F.col("id")})
    found = top_k(rows, embedder([text])[0].tolist(), k, min_score, where)
    return found.select("file_path", "content", "start_line", "end_line", "chunk_type", "name", "language", "score").orderBy(F.desc("score"), "file_path", "start_line")


def search_message(found: DataFrame) -> DataFrame:
    """One row with ``message``: how many chunks a search found, and their mean
    score in three decimals."""
    n = F.count(F.lit(1))
    return found.agg(F.when(n == 0, "No relevant results").otherwise(F.format_string("Found %d result(s), average score %.3f", n, F.avg("score"))).alias("message"))


def search_event(found: DataFrame, project_id: str, session_id: str, agent_id: str, text: str, now: Column, file: str | None = None, language: str | None = None) -> DataFrame:
    """The one row of the event log that tells of a search: its text and filters,
    how many chunks it found, and the paths and scores of the best five.  found
    has at most k rows."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "file_path", "score"))), 1, 5)
    top = F.transform(best, lambda x: F.struct(x["file_path"].alias("path"), x["score"].alias("score")))
    filters = F.struct(F.lit(file).cast("string").alias("file"), F.lit(language).cast("string").alias("lang"))
    data = F.to_json(F.struct(F.lit(text).alias("query"), filters.alias("filters"), F.col("n").alias("resultCount"), F.col("top").alias("topResults")))
    return found.agg(F.count(F.lit(1)).alias("n"), top.alias("top")).select(
        F.lit(project_id).alias("project_id"), F.lit(session_id).alias("session_id"), F.lit(agent_id).alias("agent_id"), F.lit("search").alias("event_type"), data.alias("data"), now.alias("ts"), F.unix_micros(now).alias("seq")
    )


def search_snippets(found: DataFrame, most: int = 200) -> DataFrame:
    """What a reasoner is shown of a search: (file, type, name, score, preview),
    the score in two decimals and at most ``most`` characters of each chunk."""
    shown = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    return found.select(F.col("file_path").alias("file"), F.col("chunk_type").alias("type"), "name", F.format_number(F.col("score"), 2).alias("score"), shown.alias("preview"))


def file_chunks(index: DataFrame, project_id: str, path: str) -> DataFrame:
    """The chunks of one file in order; the project's partition is read alone."""
    return index.where((F.col("project_id") == project_id) & (F.col("file_path") == path)).orderBy("start_line", "end_line", "id")
