"""Scanning folders of files, and reading and writing single ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.functions.text import extension, is_code_file, language
from recall_engine.operators.ranges import settled
from recall_engine.sources.ignore import Rule, file_system, ignored, load_rules


def file_rows(files: DataFrame, root: str) -> DataFrame:
    """(path, absolute_path, hash, size, mtime, language, extension, content) of
    rows of Spark's binaryFile source; path is relative to ``root``."""
    whole = F.regexp_replace("path", "^file:/+", "/")
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:") + "/"
    inner = F.when(whole.startswith(base), F.expr(f"substring(absolute_path, {len(base) + 1})")).otherwise(F.substring_index("absolute_path", "/", -1))
    rows = files.withColumn("absolute_path", whole).withColumn("path", inner)
    return rows.select(
        "path",
        "absolute_path",
        F.sha2("content", 256).alias("hash"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        language(F.col("path")).alias("language"),
        extension(F.col("path")).alias("extension"),
        F.col("content").cast("string").alias("content"),
    )


def wanted(path: Column, rules: list[Rule], include_hidden: bool = False) -> Column:
    """Whether a scan takes a relative path: code, not ignored, and not hidden."""
    seen = is_code_file(path) & ~ignored(path, rules)
    return seen if include_hidden else seen & ~F.exists(F.split(path, "/"), lambda x: x.startswith("."))


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", uri)))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What folders (root, folder) hold directly."""
    for batch in batches:
        for root, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            files, base = _opened(root)
            base = base.rstrip("/")
            found = files.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/") or "/", recursive=False))
            rows = [(root, x.path[len(base) :].lstrip("/"), x.type == pafs.FileType.Directory, x.size or 0, x.mtime) for x in found if x.type in (pafs.FileType.File, pafs.FileType.Directory)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["root", "path", "is_folder", "size", "mtime"])


def list_files(spark: SparkSession, root: str, rules: list[Rule], include_hidden: bool = False, most_depth: int = 100) -> DataFrame:
    """(root, path, size, mtime) of the files below a folder, contents unread.

    Folders are listed in parallel tasks, level by level; ignored ones, and
    hidden ones without ``include_hidden``, are not entered.  Links to folders
    are followed, so below ``most_depth`` levels an error is raised."""
    folders, levels = spark.createDataFrame([(root, "")], "root string, path string"), []
    while len(levels) <= most_depth:
        # every folder in a task of its own where there are few
        found = settled(folders.repartition("path").mapInArrow(_listed, "root string, path string, is_folder boolean, size long, mtime timestamp"))
        levels.append(found.where("NOT is_folder").drop("is_folder"))
        seen = ~ignored(F.col("path"), rules, folder=True)
        folders = found.where("is_folder").where(seen if include_hidden else seen & ~F.substring_index("path", "/", -1).startswith(".")).select("root", "path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)
    raise RecursionError(f"folders below {root} are nested more than {most_depth} deep")


#: Bytes of contents that a task hands on at once.
BATCH_BYTES = 8 << 20


def read_files(listed: DataFrame) -> DataFrame:
    """(path, modificationTime, length, content) of listed files (root, path, size,
    mtime); path is absolute.  Files that are gone by now have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "modificationTime", "length", "content"]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()), strict=True)], names)
        rows, held = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                files, base = _opened(x["root"])
                try:
                    with files.open_input_file(f"{base.rstrip('/')}/{x['path']}") as source:
                        content = source.read()
                except FileNotFoundError:
                    continue
                rows.append((f"{x['root'].rstrip('/')}/{x['path']}", x["mtime"], len(content), content))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return listed.select("root", "path", "size", "mtime").mapInArrow(run, "path string, modificationTime timestamp, length long, content binary")


def scan_files(spark: SparkSession, root: str, most_bytes: int = 10 << 20, include_hidden: bool = False, rules: list[Rule] | None = None, include_empty: bool = False, own: str | None = None) -> DataFrame:
    """file_rows of the code files below ``root``: listed first, and only those
    that are kept are read, in parallel.

    Ignored (``rules``, or the root's ignore files and the folder ``own``) and oversize files stay out,
    hidden ones (by their name or a folder's) unless ``include_hidden``, and
    empty ones, which hold nothing to index, unless ``include_empty``.  A root that isn't a folder raises.
    """
    rules = load_rules(spark, root, own) if rules is None else rules
    files, place = file_system(spark, root)
    if not files.exists(place) or not files.getFileStatus(place).isDirectory():
        raise NotADirectoryError(root)
    kept = list_files(spark, root, rules, include_hidden).where((F.col("size") <= most_bytes) & (F.lit(include_empty) | (F.col("size") > 0)) & wanted(F.col("path"), rules, include_hidden))
    dealt = kept.repartitionByRange(max(1, -(-(kept.agg(F.sum("size")).first()[0] or 0) // (64 << 20)), spark.sparkContext.defaultParallelism), "path")
    return file_rows(read_files(dealt), root)


def scan_file(spark: SparkSession, path: str, root: str) -> DataFrame:
    """file_rows of one file, whatever the ignore rules and its size; no row if
    it isn't there or isn't code."""
    files, place = file_system(spark, path)
    if not files.exists(place) or files.getFileStatus(place).isDirectory():
        return file_rows(spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary"), root)
    return file_rows(spark.read.format("binaryFile").load(path), root).where(is_code_file(F.col("path")))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file on any file system, folders included."""
    files, place = file_system(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_file(spark: SparkSession, root: str, path: str, text: str, agent_id: str, held: DataFrame) -> str | None:
    """Writes ``path`` below ``root`` unless another agent holds its lock.

    held: locks (resource, holder).  Returns that agent, or None once written;
    scan_file then gives the row to re-index.
    """
    other = held.where((F.col("resource") == path) & (F.col("holder") != agent_id)).select("holder").first()
    if other:
        return other[0]
    put_text(spark, f"{root.rstrip('/')}/{path}", text)
    return None


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of the Markdown files of a folder, without the extension."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return files.select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "").alias("name"), F.col("content").cast("string").alias("content"))


def changed(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Rows of ``current`` that are new, differ by hash, or all with ``force``."""
    old = stored.select(F.col("path"), F.col("hash").alias("old_hash"))
    return current.join(old, "path", "left").where(F.lit(force) | F.col("old_hash").isNull() | (F.col("old_hash") != F.col("hash"))).drop("old_hash")
