"""Embedding of texts with a cache keyed by content.

An embedder is a function from a list of texts to an array of vectors.  The
one here needs no model: signed hashes of words, brought to length 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashed_words(dimensions: int = 256) -> Embedder:
    """Each lower-cased word adds 1 or -1 in the place its hash names."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float64)
        for row, text in enumerate(texts):
            codes = np.array([zlib.crc32(w.encode()) for w in text.lower().split()], np.int64)
            np.add.at(out[row], codes % dimensions, np.where(codes >> 31 & 1, 1.0, -1.0))
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).astype(np.float32)

    return embed


def embed_texts(rows: DataFrame, embedder: Embedder, text_col: str = "content", into: str = "vector", batch: int = 100) -> DataFrame:
    """Adds ``into`` (array<float>), ``batch`` texts a call; null counts as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                part[into] = [*embedder([x or "" for x in part[text_col]])]
                yield part

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != into)
    return rows.drop(into).mapInPandas(run, f"{fields}, `{into}` array<float>")


def embed_with_cache(chunks: DataFrame, cache: DataFrame, model: str, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, rows to add to the cache).

    A cached vector counts if chunk, content hash and model are equal; only the
    other chunks are embedded.  The cache has (chunk_id, content_hash, model, vector).
    """
    keyed = chunks.drop("vector").withColumns({"content_hash": F.sha2("content", 256), "model": F.lit(model)})
    known = cache.where(F.col("model") == model).select(F.col("chunk_id").alias("id"), "content_hash", "vector")
    looked = keyed.join(known, ["id", "content_hash"], "left")
    fresh = embed_texts(looked.where("vector IS NULL").drop("vector"), embedder)
    rows = looked.where("vector IS NOT NULL").unionByName(fresh)
    return rows.drop("content_hash", "model"), fresh.select(F.col("id").alias("chunk_id"), "content_hash", "model", "vector")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model").agg(F.count(F.lit(1)).alias("vectors"))


CACHE = "chunk_id string, content_hash string, model string, vector array<float>"


def _cache_place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def save_cache(rows: DataFrame, path: str) -> None:
    """Appends rows of CACHE, new ones of a run, to a cache in a folder."""
    rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), "content_hash", "model", "vector").write.mode("append").parquet(path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CACHE, one for each chunk, content and model; none where no cache is."""
    files, place = _cache_place(spark, path)
    if not files.exists(place):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).dropDuplicates(["chunk_id", "content_hash", "model"])


def clear_cache(spark: SparkSession, path: str) -> None:
    """Deletes a cache; one that isn't there is no error."""
    files, place = _cache_place(spark, path)
    files.delete(place, True)
