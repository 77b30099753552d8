"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.llm.stage import written

#: Rows, and queries, of one bucket that one task compares; larger ones are dealt out.
BLOCK_ROWS = 4096
#: Large buckets that may be broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Hashing:
    """tables; each joins as many cross-polytope hashes as make about one bucket
    for ``bucket_rows`` rows.  A query looks in ``probes`` buckets of a table
    where one hash has enough of them, and in 2 ** ``growth`` times as many for
    each bit more."""

    tables: int = 16
    bucket_rows: int = 16
    probes: int = 3
    growth: float = 0.72
    seed: int = 7

    def axes(self, width: int, rows: int) -> list[int]:
        """How many axes each hash of a table chooses among: all of them, but for
        the last one."""
        first = (2 * width).bit_length() - 1
        bits = max(first, int(np.ceil(np.log2(max(rows, 1) / self.bucket_rows))))
        whole, rest = divmod(bits, first)
        return [width] * whole + ([1 << (rest - 1)] if rest else [])

    def looks(self, width: int, rows: int) -> int:
        """Buckets of a table that a query looks in."""
        bits = sum((2 * x).bit_length() - 1 for x in self.axes(width, rows))
        return int(np.ceil(self.probes * 2 ** (self.growth * (bits - (2 * width).bit_length() + 1))))


@lru_cache(maxsize=256)
def _signs(width: int, table: int, place: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width, table, place]).choice([-1.0, 1.0], (3, width))


@lru_cache(maxsize=8)
def _hadamard(size: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, eight-way and
    with its coordinates in another order: a pseudo-rotation."""
    n, width = x.shape
    for s in signs:
        x, left = x * s, width
        while left > 1:
            step = min(8, left)
            x = (x.reshape(-1, step) @ _hadamard(step)).reshape(n, width // step, step).transpose(0, 2, 1).reshape(n, width)
            left //= step
    return x


def width_of(dim: int) -> int:
    return 1 << max(1, (int(dim) - 1).bit_length())


def probed(vectors: np.ndarray, how: Hashing, table: int, rows: int, looks: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sub), each (vectors, looks): the buckets of a table nearest to
    each vector, nearest first.

    A hash is the nearest signed axis of the rotated vector; axis + width stands
    for the negative direction.  bucket joins all hashes of the table but the
    last of several, sub is that one.  Further buckets are those that lose least
    by squared distance from the nearest axes: the best prefixes are extended by
    all axes of the next hash.
    """
    n, dim = vectors.shape
    width = width_of(dim)
    padded = np.zeros((n, width))
    padded[:, :dim] = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    loss, bucket, sub = np.zeros((n, 1)), np.zeros((n, 1), np.int64), np.zeros((n, 1), np.int64)
    sizes = how.axes(width, rows)
    for place, size in enumerate(sizes):
        r = rotate(padded, _signs(width, table, place, how.seed))[:, :size] / width**1.5
        both = np.concatenate([r, -r], axis=1)
        more = (both.max(axis=1, keepdims=True) - both) ** 2
        total = (loss[:, :, None] + more[:, None, :]).reshape(n, -1)
        if looks == 1:
            best = total.argmin(axis=1)[:, None]
        else:
            best = np.argsort(total, axis=1, kind="stable")[:, :looks]
        before, axis = best // (2 * size), best % (2 * size)
        loss, bucket = np.take_along_axis(total, best, 1), np.take_along_axis(bucket, before, 1)
        if place and place == len(sizes) - 1:
            sub = axis
        else:
            bucket = bucket * (2 * size) + axis
    return bucket, np.broadcast_to(sub, bucket.shape)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat values, first value of each row, length of each row); nulls are NaN."""
    values = column.flatten().cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)
    size = np.array([len(x) if x is not None else -1 for x in column.to_pylist()]) if column.null_count else np.diff(np.asarray(column.offsets))
    ends = np.cumsum(np.maximum(size, 0))
    return flat, ends - np.maximum(size, 0), size


_BUCKET = "table int, dim int, bucket long"


def _hashed(rows: DataFrame, how: Hashing, size: int, query: bool) -> DataFrame:
    """(vec_id, embedding, table, dim, bucket, subs) of the vectors that take
    part: one row for each bucket of each table that a vector lies in or, as a
    query, looks in; subs are the parts of the bucket."""

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 1024):
                batch = whole.slice(begin, 1024)
                flat, first, length = _matrix(batch.column(1))
                for dim in np.unique(length[length > 0]):
                    at = np.flatnonzero(length == dim)
                    x = flat[first[at][:, None] + np.arange(dim)]
                    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    at, x = at[good], x[good]
                    if not len(at):
                        continue
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    for table in range(how.tables):
                        bucket, sub = probed(x, how, table, size, how.looks(width_of(dim), size) if query else 1)
                        row = np.repeat(np.arange(len(at)), bucket.shape[1])
                        order = np.lexsort((sub.ravel(), bucket.ravel(), row))
                        row, bucket, sub = row[order], bucket.ravel()[order], sub.ravel()[order]
                        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
                        part = batch.take(pa.array(at[row[new]]))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(sub.astype(np.int32)))
                        n = len(new)
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(n, table, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(bucket[new]), lists], ["vec_id", "embedding", "table", "dim", "bucket", "subs"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, embedding {kind}, {_BUCKET}, subs array<int>")


def _nearest(queries: np.ndarray, rows: np.ndarray, query_id: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, cosine) of the k best ids of each query in a block,
    each with the best of its rows.

    A matrix product finds who may be among them; their cosines are then
    computed one by one, so that equal vectors have equal scores.
    """
    by_id = np.argsort(vec_id, kind="stable")
    rows, vec_id = rows[by_id], vec_id[by_id]
    first = np.flatnonzero(np.diff(vec_id, prepend=vec_id[:1] - 1))
    nq, nr = np.sqrt((queries * queries).sum(axis=1)), np.sqrt((rows * rows).sum(axis=1))
    out = []
    for at in range(0, len(queries), 256):
        part = slice(at, at + 256)
        about = (queries[part] @ rows.T) / (nq[part, None] * nr)
        about[query_id[part, None] == vec_id] = -np.inf
        once = about if len(first) == len(rows) else np.maximum.reduceat(about, first, axis=1)
        line = np.partition(once, -k, axis=1)[:, -k] if len(first) > k else np.full(len(about), -2.0)
        i, j = np.nonzero(about >= np.maximum(line[:, None] - 1e-9, -2.0))
        score = np.concatenate([(queries[part][i[a : a + 65536]] * rows[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)] or [np.zeros(0)]) / (nq[part][i] * nr[j])
        order = np.lexsort((vec_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        if len(first) < len(rows):
            best = np.sort(np.unique(np.stack([i, vec_id[j]]), axis=1, return_index=True)[1])
            i, j, score = i[best], j[best], score[best]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < k
        out.append((query_id[part][i[best]], vec_id[j[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_parts(q: np.ndarray, q_id: np.ndarray, q_subs: pa.ListArray | None, r: np.ndarray, r_id: np.ndarray, r_sub: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_nearest in each part of a bucket that a query looks in (all, if q_subs is None)."""
    if q_subs is None:
        return _nearest(q, r, q_id, r_id, k)
    of = np.repeat(np.arange(len(q)), np.diff(np.asarray(q_subs.offsets)))
    asked = np.asarray(q_subs.flatten())
    by_q, by_r = np.lexsort((of, asked)), np.argsort(r_sub, kind="stable")
    parts, starts = np.unique(r_sub[by_r], return_index=True)
    found = []
    for part, a, b in zip(parts, starts, [*starts[1:], len(r)], strict=True):
        who = of[by_q[slice(*np.searchsorted(asked[by_q], [part, part + 1]))]]
        if len(who):
            among = by_r[a:b]
            found.append(_nearest(q[who], r[among], q_id[who], r_id[among], k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    ids, near, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((near, -score, ids))
    ids, near, score = ids[order], near[order], score[order]
    best = np.arange(len(ids)) - np.searchsorted(ids, ids) < k * 2
    return ids[best], near[best], score[best]


def _compare(rows: DataFrame, queries: DataFrame, k: int, all_parts: bool = False) -> DataFrame:
    """Both sides are rows of _hashed: compares within each bucket.  Rows and
    queries of large buckets are cut into blocks that meet each other."""
    at = ["table", "dim", "bucket"]
    many = lambda x, name: x.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name)).where(F.col(name) > 1)
    large = written(many(rows, "blocks").join(many(queries, "q_blocks"), at, "full_outer"), "large-buckets")
    if large.count() <= MOST_BROADCAST:
        large = F.broadcast(large)
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    mine = lambda c: F.pmod(F.xxhash64("vec_id", "table"), one(c)).cast("int")
    others = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    by = [*at, "block", "q_block"]
    dealt = rows.join(large, at, "left").withColumn("block", mine("blocks")).withColumn("q_block", others("q_blocks")).drop("blocks", "q_blocks")
    asked = queries.join(large, at, "left").withColumn("q_block", mine("q_blocks")).withColumn("block", others("blocks")).drop("blocks", "q_blocks")

    def run(asked: pa.Table, dealt: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if asked.num_rows and dealt.num_rows:
            q, r = (np.asarray(x.column("embedding").combine_chunks().flatten().cast(pa.float64())).reshape(x.num_rows, -1) for x in (asked, dealt))
            subs = None if all_parts else asked.column("subs").combine_chunks()
            found = _in_parts(q, np.asarray(asked.column("vec_id")), subs, r, np.asarray(dealt.column("vec_id")), np.asarray(dealt.column("subs").combine_chunks().flatten()), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    return asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, *, k: int = 5, how: Hashing = Hashing(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows found.

    Every row is put in one bucket of each table: the nearest signed axes of its
    rotated unit vector.  A query looks in the nearest buckets of each table,
    and the rows met there are ranked by exact cosine in double precision, ties
    to the smaller id.  Buckets get smaller than the table grows: the number of
    hashes and of probes follows the number of rows (Hashing).  A query that
    meets fewer than k rows looks in all buckets of one table, so it gets k rows
    or all there are.

    Null vectors, empty or zero ones, and those with null or non-finite
    components take no part on either side, nor do null ids; vectors of
    different lengths never meet.  Rows of equal id count as one with its best
    score, and a query never meets a row of its own id.  Empty tables give no
    rows; other columns go.
    """

    def read(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).dropDuplicates(["vec_id", "embedding"])

    # copies of a row would take the places of other rows
    size = rows.count()
    indexed, asked = _hashed(read(rows), how, size, False), _hashed(read(queries), how, size, True)
    first = written(_best(_compare(indexed, asked, k), k), "neighbours")
    enough = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = written(asked.where(F.col("table") == 0).dropDuplicates(["vec_id", "embedding"]).join(enough, "vec_id", "left_anti"), "short-queries")
    if short.isEmpty():
        return first.select("query_id", "rank", "vec_id", "score")
    table = written(indexed.where(F.col("table") == 0), "one-table")
    everywhere = short.drop("bucket").join(written(table.select("dim", "bucket").distinct(), "all-buckets"), "dim")
    more = _compare(table, everywhere.select(*short.columns), k, all_parts=True)
    return _best(first.select("query_id", "vec_id", "score").unionByName(more), k).select("query_id", "rank", "vec_id", "score")
