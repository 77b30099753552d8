"""Where intermediate tables go, and how rows are keyed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null document id counts as in orderings: before every other id.
NULL_ID = -(2**63)

#: A key is hot from this share of all rows on, so there are at most as many hot
#: keys; below LEAST_HOT rows no key is.
HOT_SHARE, LEAST_HOT, SALTS = 2_000, 500, 64

#: Folders made for applications in this process that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only where that setting is absent and all executors run in this process
    (tests) is a folder of our own made; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="recall-shared-"))
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage so that a lost
    executor costs a reread, not a recomputation of everything before."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more.  What was made
    of them must be written itself, so that no lost executor asks for them."""
    for table in tables:
        if table is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row.  Rows of equal id and text share it, which is right:
    every decision on them is the same."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): nulls become NULL_ID and the empty text; other columns go."""
    return docs.select(
        row_key(id_col, text_col).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def public_id(col: str = "id") -> Column:
    """The id as given: NULL_ID turns back into null."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


def join_hot(rows: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined with right (``how``: inner or left), where ``counts`` (on, n) says how many rows a key
    has.  Keys of a 2,000th of all rows or more, thus at most 2,000, are salted:
    their rows are dealt over many tasks, and what they meet is copied to each."""
    least = max(LEAST_HOT, -(-total // HOT_SHARE))
    hot = F.broadcast(counts.where(F.col("n") >= least).select(*on, F.least(F.lit(SALTS), F.ceil(F.col("n") / least)).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.join(hot, on, "left").withColumn("salt", F.when(salts == 1, 0).otherwise(F.pmod(F.xxhash64(*rows.columns), salts)).cast("int")).drop("salts")
    copied = right.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return dealt.join(copied, [*on, "salt"], how).drop("salt")
