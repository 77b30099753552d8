"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 distance in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """How far two vectors are apart: squared L2, 1 - cosine (1 from a zero
    vector), or the dot product with its sign turned."""
    if metric == "l2":
        return squared_distance(a, b)
    if metric == "dot":
        return -dot_product(a, b)
    if metric == "cosine":
        size = F.sqrt(dot_product(a, a)) * F.sqrt(dot_product(b, b))
        return 1 - F.coalesce(F.try_divide(dot_product(a, b), size), F.lit(0.0))
    raise ValueError(f"no metric {metric}: one of l2, cosine, dot")


def top_k(rows: DataFrame, query: Sequence[float], k: int = 10, min_score: float | None = None, where: Column | None = None, metric: str = "l2") -> DataFrame:
    """The k rows nearest to a vector: filters first, then the k, then the score
    line.  The score is 1 less the distance (half the squared L2), 0 at least;
    of dot products it is the product itself."""
    rows = rows if where is None else rows.where(where)
    d = distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)), metric)
    score = {"l2": F.greatest(F.lit(0.0), 1 - F.col("distance") / 2), "cosine": F.greatest(F.lit(0.0), 1 - F.col("distance")), "dot": -F.col("distance")}[metric]
    found = rows.withColumn("distance", d).orderBy("distance", "vec_id").limit(k or 10).withColumn("score", score)
    return found if min_score is None else found.where(F.col("score") >= min_score)


#: Queries that one pass over the rows compares: what reaches the tasks with them.
PASS_QUERIES = 2048


def top_k_each(rows: DataFrame, queries: DataFrame, by: str, k: int = 5) -> DataFrame:
    """(by, query_id, vec_id, distance, rank): the k rows nearest to each query
    within the rows of its group ``by``, by squared L2, ties to the smaller id.

    rows, queries: (by, vec_id, embedding).  Queries go to the tasks in blocks of
    PASS_QUERIES; a task compares them with its rows by a matrix product a batch
    and hands on the k best of each query only, so what is shuffled follows
    queries x tasks and not the pairs.  Distances are then taken from the
    vectors' differences, with all rows that rounding may have put behind.
    Vectors that are null, of another length than the query's or hold nulls or
    values that aren't finite take no part.
    """
    kind, whole = rows.schema[by].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()
    schema = f"`{by}` {kind}, query_id {whole}, vec_id {whole}, distance double"
    narrow = rows.select(by, "vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    # in blocks by number, so that the driver holds one block
    asked = queries.select(F.col(by).alias("by"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").toLocalIterator()
    found = None
    while block := list(islice(asked, PASS_QUERIES)):
        more = narrow.mapInArrow(_nearest_of_block(block, by, k), schema)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = narrow.select(by, F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("distance")).limit(0)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_of_block(block: list, by: str, k: int):
    """Keeps the k best rows of each query of a block over the batches of a task."""
    groups: dict = {}
    for q in block:
        groups.setdefault((q["by"], len(q["v"])), []).append(q)
    asked = {key: ([q["id"] for q in qs], np.array([q["v"] for q in qs])) for key, qs in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[tuple[float, object]]] = {}
        types = None
        for batch in batches:
            types = (batch.column(0).type, batch.column(1).type)
            keys, ids = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            ends, flat = np.asarray(batch.column(2).offsets), np.asarray(batch.column(2).values)
            size = np.diff(ends)
            for (key, dim), (names, q) in asked.items():
                mine = np.flatnonzero((keys == key) & (size == dim))
                if not len(mine):
                    continue
                rows = flat[ends[mine][:, None] + np.arange(dim)]
                finite = np.isfinite(rows).all(1)
                mine, rows = mine[finite], rows[finite]
                if not len(mine):
                    continue
                norms = (rows * rows).sum(1), (q * q).sum(1)
                about = norms[0][:, None] + norms[1] - 2 * rows @ q.T
                # rounding moves a sum by less than this
                room = 1e-9 * (norms[0].max() + norms[1]) + 1e-12
                line = np.partition(about, min(k, len(mine)) - 1, axis=0)[min(k, len(mine)) - 1] + room
                for j, name in enumerate(names):
                    near = np.flatnonzero(about[:, j] <= line[j])
                    exact = ((rows[near] - q[j]) ** 2).sum(1)
                    held = best.get((key, name), []) + [(d, ids[mine[x]]) for d, x in zip(exact.tolist(), near.tolist(), strict=True)]
                    best[key, name] = sorted(held)[:k]
        rows = [(key, name, i, d) for (key, name), held in best.items() for d, i in held]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (types[0], types[1], types[1], pa.float64()), strict=True)], [by, "query_id", "vec_id", "distance"])

    return run
