"""Token ids as ORC files in id order.

The ids are written as array<int>, which ORC stores by its integer run-length
encoding, in stripes that readers take in parallel.  Row indexes and Bloom
filters on the document id let a reader skip stripes and row groups that can't
hold an id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_engine.llm.stage import keyed, public_id, written
from recall_engine.llm.textcols import slices
from recall_engine.llm.tokenize import id_lists, unit_encoder

FILE_SCHEMA = "doc_id long, part int, pos long, ids array<int>"


def write_token_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    *,
    keeps_space: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = 64 << 20,
    index_stride: int = 10_000,
) -> None:
    """Encodes every whole text, appends ``end_id`` and writes ORC in ascending id order.

    File columns: doc_id, part (number of the file's task), pos (row in the
    part), ids.  Ids ascend over parts and, within one, over pos.  Null text
    counts as empty (its row holds the end id alone), a null id comes first and
    reads back as null; rows of equal id stand in the order of their text's
    hash, repeated rows side by side.  An empty table gives files without rows.
    Other columns are not written.

    The range exchange carries texts, not ids, so its sampling costs a scan and
    no encoding.
    """

    def run(batches):
        encoder = unit_encoder(vocabulary, keeps_space)
        part, pos = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for batch in slices(batches):
            n = batch.num_rows
            arrays = [np.concatenate([x, end]) for x in encoder.encode(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), id_lists(arrays)], ["doc_id", "part", "pos", "ids"])
            pos += n

    dealt = keyed(docs, id_col, text_col).repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    out = dealt.mapInArrow(run, FILE_SCHEMA).withColumn("doc_id", public_id("doc_id"))
    (
        out.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", index_stride)
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.compress", "zstd")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows.  A filter on doc_id reaches ORC's indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def token_offsets(rows: DataFrame) -> DataFrame:
    """(part, pos, doc_id, start, n_tokens, ids_crc32) for rows of read_token_ids.

    start counts the ids of all rows before, over the whole set of files.  Only
    one total for each part goes through the driver.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            ends = np.asarray(ids.offsets)
            flat = np.asarray(ids.values).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["part", "pos", "doc_id", "n_tokens", "ids_crc32"])

    sums = written(rows.mapInArrow(run, "part int, pos long, doc_id long, n_tokens long, ids_crc32 long"), "token-sums")
    totals = sorted((r["part"], r["n"]) for r in sums.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    spark = rows.sparkSession
    base = spark.createDataFrame(before, "part int, base long")
    ahead = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.join(F.broadcast(base), "part")
        .withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))
        .select("part", "pos", "doc_id", "start", "n_tokens", "ids_crc32")
    )
