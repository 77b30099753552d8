"""Importance resampling towards a target distribution.

Features are hashed into buckets; a bucket's gain says how much more frequent it
is in the target than in the corpus.  A document's weight is the sum of its
features' gains, read from an array; with Gumbel noise from its id the highest
scores are a sample drawn without replacement.

Ranks come from parallel sorting by regular sampling: runs are sorted where they
are scored, every so-many-th row of a run is a sample, samples give splitters,
rows go to the segment between two splitters, segments are sorted by themselves
and the counts of the segments before give each row its exact rank.
"""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.llm.stage import NULL_ID, discard, keyed, public_id, written
from recall_engine.llm.textcols import NOT_TERM, SLICE_BYTES, Words, sequence_numbers, stretches

#: Samples that the driver sorts, about, and most segments they are cut into.
SAMPLES, MOST_SEGMENTS = 1 << 15, 1 << 12
#: Rows of a segment where more than four segments a shuffle partition are needed.
SEGMENT_ROWS = 1 << 20


def feature_buckets(words: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of all runs of 1 to ``longest`` words: the crc32 of the
    words, joined by one space, modulo ``buckets``."""
    numbers, different = words.known()
    for n in range(1, longest + 1):
        if len(numbers) < n:
            return
        if n == 1:
            row, number, texts = words.row, numbers, different
        else:
            first = np.flatnonzero(words.row[n - 1 :] == words.row[: len(numbers) - n + 1])
            parts = [numbers[first + i] for i in range(n)]
            _, at, number = np.unique(sequence_numbers(parts), return_index=True, return_inverse=True)
            row, texts = words.row[first], (b" ".join(different[p[i]] for p in parts) for i in at)
        crc = np.fromiter((zlib.crc32(x) % buckets for x in texts), np.int64)
        yield row, crc[number]


def _pieces(batches, longest: int):
    # runs of several words would be cut where a text is
    return stretches(batches, NOT_TERM, limit=SLICE_BYTES if longest == 1 else sys.maxsize)


def bucket_counts(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all features of rows (id, text)."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for _, text, _ in _pieces(batches, longest):
            for _, found in feature_buckets(Words(text, lower=True, separator=NOT_TERM), longest, buckets):
                counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    return rows.select("id", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Gain of each bucket: floor(1000 * ln of (t + 1)(S + B) / ((s + 1)(T + B))).
    At most ``buckets`` counts of either side reach the driver."""
    s, t = ({r["bucket"]: r["n"] for r in bucket_counts(x, longest, buckets).collect()} for x in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets)))) for b in range(buckets)], np.int64)


def noise(ids: list[int], seed: str) -> np.ndarray:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of each id;
    the null id hashes as no characters."""
    h = np.array([int(hashlib.sha256(f"{seed}:{'' if i == NULL_ID else i}".encode()).hexdigest()[:8], 16) for i in ids], np.float64)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def score_documents(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row of docs.

    Words are runs of letters, digits and other characters than ASCII of whole
    texts, A-Z in lower case; features are all runs of 1 to ``longest`` words.
    target: rows with a text column of the same name.  Null and empty texts have
    no features and weight 0; repeated rows count each; without target or corpus
    features the gains follow from zero counts; other columns are not read.
    Long texts are read in stretches where ``longest`` is 1.
    """
    rows = keyed(docs, id_col, text_col).select("id", "text")
    aims = target.select(F.lit(0).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gains = bucket_gains(rows, aims, longest, buckets)

    def run(batches):
        held = np.zeros(3, np.int64)
        for batch, text, ends in _pieces(batches, longest):
            words = Words(text, lower=True, separator=NOT_TERM)
            sums = np.zeros((3, batch.num_rows), np.int64)
            sums[0] = words.count
            for row, bucket in feature_buckets(words, longest, buckets):
                sums[1] += np.bincount(row, minlength=batch.num_rows)
                sums[2] += np.bincount(row, gains[bucket], minlength=batch.num_rows).astype(np.int64)
            if not ends:
                held += sums[:, 0]
                continue
            sums[:, 0] += held
            held[:] = 0
            ids = batch.column(0)
            score = sums[2] + noise(ids.to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in sums), pa.array(score)], ["id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def rank_highest(rows: DataFrame, among: str, percent: int) -> DataFrame:
    """rows (id, score, ...) with ``rank``: 1, 2, 3... down the floor(percent * N
    / 100) highest scores of the N rows for which ``among`` (an SQL condition)
    holds, equal scores by ascending id; null on all other rows.

    Rows of equal score and id stand in the order of their place in the runs, so
    ranks stay unique.  The driver gets about SAMPLES keys and a count a segment.
    """
    spark = rows.sparkSession
    open_ = F.expr(f"coalesce({among}, false)")
    # place: number of the run, then from 0 in it; rows that take part come first
    runs = written(rows.withColumn("open", open_).sortWithinPartitions(F.desc("open"), F.desc("score"), "id").withColumn("place", F.monotonically_increasing_id()), "runs")
    n = runs.where("open").count()
    draw = percent * n // 100
    step = max(1, n // SAMPLES)
    run, pos = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    samples = runs.where("open").where(F.pmod(pos + F.pmod(F.xxhash64(run), F.lit(step)), F.lit(step)) == 0).select("score", "id", "place").toPandas()
    keys = samples.sort_values(["score", "id", "place"], ascending=[False, True, True], ignore_index=True)
    segments = min(MOST_SEGMENTS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SEGMENT_ROWS)))
    at = np.unique(np.arange(1, segments) * len(keys) // segments)
    splitters = keys.iloc[at[at < len(keys)]][["score", "id", "place"]].to_numpy(np.int64)

    def split(batches):
        for batch in batches:
            mine = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("score", "id", "place")], 1)
            both = np.concatenate([splitters, mine])
            # a splitter comes before its own row, which begins its segment
            order = np.lexsort([np.arange(len(both)) >= len(splitters), both[:, 2], both[:, 1], -both[:, 0]])
            segment = np.empty(len(both), np.int64)
            segment[order] = np.cumsum(order < len(splitters))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment[len(splitters) :].astype(np.int32))], [*batch.schema.names, "segment"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields) + ", segment int"
    dealt = runs.where("open").mapInArrow(split, schema)
    counts = {r["segment"]: r["count"] for r in dealt.groupBy("segment").count().collect()}
    before, total, last = [], 0, -1
    for segment in range(len(splitters) + 1):
        before.append((segment, total))
        if total < draw:
            last = segment
        total += counts.get(segment, 0)
    base = F.broadcast(spark.createDataFrame(before, "segment int, before long"))
    inside = Window.partitionBy("segment").orderBy(F.desc("score"), "id", "place")
    rank = F.col("before") + F.row_number().over(inside)
    high = dealt.where(F.col("segment") <= last).join(base, "segment").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    low = dealt.where(F.col("segment") > last).unionByName(runs.where(~F.col("open")).withColumn("segment", F.lit(None).cast("int"))).withColumn("rank", F.lit(None).cast("long"))
    out = [*rows.columns, "rank"]
    return high.select(out).unionByName(low.select(out))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs:
    ``percent`` of the rows with ``least_words`` words or more are drawn and
    ranked, as score_documents and rank_highest say; undrawn rows have no rank."""
    scored = score_documents(docs, target, longest, buckets, seed, id_col, text_col)
    return rank_highest(scored, f"n_words >= {least_words}", percent).select(public_id("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
