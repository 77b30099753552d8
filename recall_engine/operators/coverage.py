"""What an index holds of the files there are: totals, trees, gaps, advice.

``status`` rows come from file_status: a row per file with its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.operators.ranges import running

PENDING, INDEXED, MISSING = "pending_reindex", "indexed", "not_indexed"


def file_status(files: DataFrame, index: DataFrame, pending: Column | None = None, on: str = "path") -> DataFrame:
    """files with (status, chunks): indexed, pending_reindex where the index is
    out of date, not_indexed where it lacks the file.

    index: a row per file (``on``, hash, chunks) at most; by default a file is
    pending where its hash differs.  A null chunk count counts as 0.
    """
    held = index.select(on, F.col("hash").alias("_hash"), F.col("chunks").cast("long").alias("_chunks"), F.lit(True).alias("_held"))
    stale = F.col("hash") != F.col("_hash") if pending is None else pending
    state = F.when(F.col("_held").isNull(), MISSING).when(F.coalesce(stale, F.lit(True)), PENDING).otherwise(INDEXED)
    return files.join(held, on, "left").withColumns({"status": state, "chunks": F.coalesce("_chunks", F.lit(0))}).drop("_hash", "_chunks", "_held")


def _counts(size: str | None) -> list[Column]:
    counts = [F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(name) for s, name in ((INDEXED, "indexed"), (PENDING, "pending"), (MISSING, "missing")))]
    return [*counts, F.sum("chunks").alias("chunks"), *([F.sum(size).alias("size")] if size else [])]


def totals(status: DataFrame, size: str | None = None) -> DataFrame:
    """One row: total, indexed, pending, missing, chunks, size, percent (of
    indexed files, 0 without files) and chunks_a_file (0 where nothing is indexed)."""
    found = status.agg(*_counts(size))
    return found.withColumns({"percent": F.coalesce(F.try_divide(100 * F.col("indexed"), F.col("total")), F.lit(0.0)), "chunks_a_file": F.coalesce(F.try_divide("chunks", "indexed"), F.lit(0.0))})


def by(status: DataFrame, *keys: str, size: str | None = None) -> DataFrame:
    """The counts of totals for each key, such as the language or the folder."""
    return status.groupBy(*keys).agg(*_counts(size))


def folders_above(path: Column) -> Column:
    """Every folder that holds a path, the outermost first."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def tree(status: DataFrame, path: str = "path", size: str | None = None) -> DataFrame:
    """(folder, depth, counts...) of every folder: what lies in it or below."""
    each = status.withColumn("folder", F.explode(folders_above(F.col(path))))
    return by(each, "folder", size=size).withColumn("depth", F.size(F.split("folder", "/", -1)))


def listed(status: DataFrame, path: str = "path") -> DataFrame:
    """(folder, place, name, is_folder): what each folder holds directly, folders
    first, then by name whatever its case.  A folder's names may lie in many
    tasks: places are distributed ranks."""
    whole = F.col(path)
    steps = F.concat(folders_above(whole), F.array(whole))
    each = status.select(F.posexplode(steps).alias("depth", "step"), F.size(steps).alias("n")).select(
        F.when(F.col("depth") > 0, F.regexp_replace("step", "/[^/]*$", "")).otherwise("").alias("folder"), F.substring_index("step", "/", -1).alias("name"), (F.col("depth") + 1 < F.col("n")).alias("is_folder")
    )
    items = each.distinct().withColumns({"_file": ~F.col("is_folder"), "_low": F.lower("name")})
    return running(items, ["folder"], ["_file", "_low", "name"]).select("folder", F.col("n").cast("int").alias("place"), "name", "is_folder")


def gaps(counts: DataFrame, more_than: int = 0) -> DataFrame:
    """Rows of ``by`` with nothing indexed and more than so many files."""
    return counts.where((F.col("indexed") == 0) & (F.col("total") > more_than))


def advice(whole: DataFrame, languages: DataFrame, folders: DataFrame) -> DataFrame:
    """One row with ``advice``: which of the seven rules hold, in order.

    whole: a row of totals; languages, folders: counts of ``by``.  A name list
    is one row of names with nothing indexed, folders of more than five files.
    """
    lacking = lambda rows, least: gaps(rows, least).agg(F.array_join(F.array_sort(F.collect_list(rows.columns[0])), ", ").alias("names"))
    facts = whole.crossJoin(F.broadcast(lacking(languages, 0).withColumnRenamed("names", "languages"))).crossJoin(F.broadcast(lacking(folders, 5).withColumnRenamed("names", "folders")))
    percent = F.format_number("percent", 1)
    rules = [
        F.when(F.col("percent") < 50, F.concat(F.lit("low coverage: "), percent, F.lit(" %, index the whole project"))),
        F.when((F.col("percent") >= 50) & (F.col("percent") < 80), F.concat(F.lit("medium coverage: "), percent, F.lit(" %, "), F.col("missing").cast("string"), F.lit(" files aren't indexed"))),
        F.when(F.col("percent") == 100, F.lit("complete coverage")),
        F.when(F.col("pending") > 0, F.concat(F.col("pending").cast("string"), F.lit(" files changed since they were indexed"))),
        F.when(F.col("languages") != "", F.concat(F.lit("languages not indexed: "), "languages")),
        F.when(F.col("folders") != "", F.concat(F.lit("folders not indexed: "), "folders")),
        F.when(F.col("chunks_a_file") > 20, F.concat(F.lit("many chunks a file: "), F.format_number("chunks_a_file", 1))),
    ]
    return facts.select(F.array_compact(F.array(*rules)).alias("advice"))


def index_stats(index: DataFrame) -> DataFrame:
    """One row: chunks, files, projects and the last time of an index."""
    return index.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("project_id", "file_path").alias("files"), F.count_distinct("project_id").alias("projects"), F.max("timestamp").alias("last_indexed"))


def stats_text(stats: DataFrame, now: Column, pending: int = 0) -> DataFrame:
    """One row with ``message``: what index_stats says, in words."""
    from recall_engine.functions.text import age_text

    age = F.when(F.col("last_indexed").isNotNull(), F.concat(F.lit(", last indexed "), age_text(F.col("last_indexed"), now))).otherwise("")
    tail = F.lit(f". {pending} file(s) to index again" if pending else "")
    return stats.select(F.concat(F.col("chunks").cast("string"), F.lit(" chunk(s) from "), F.col("files").cast("string"), F.lit(" file(s)"), age, tail).alias("message"))
