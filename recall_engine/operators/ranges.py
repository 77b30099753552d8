"""Ranks, running sums and greedy batches over rows in order, none of which needs
all rows of a key in one task.

Rows are dealt by ranges of (key, order), so a key lies in neighbouring parts and
each end of a part cuts one key at most.  What depends on the parts before comes
from a table of the keys that are cut: two rows a part at most, so it is
broadcast whatever the number of rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_engine.operators.folds import ordered_fold


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the session's folder, so that what follows
    doesn't compute it again.  Only where all runs in this process is a folder made."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="recall-checkpoints-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; of our own only where
    none is set and all runs in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="recall-shared-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], cost: str | None = None) -> DataFrame:
    """rows with ``n``, their number in their key from 0, ``before``, the sum of
    the costs of the rows before them, and (``part``, ``cut``): where they lie
    and whether their key lies in several parts.

    ``order`` must settle all ties that matter; a null cost counts as 0 and null
    keys as one key.  The rows travel once, so they should be narrow.
    """
    by = list(by)
    held = rows.withColumn("_cost", F.coalesce(F.col(cost).cast("long"), F.lit(0)) if cost else F.lit(0).cast("long"))
    dealt = settled(held.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part", *by).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_cost").alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    several = sums.withColumns({"_parts": F.count(F.lit(1)).over(Window.partitionBy(*by)), "_n": F.sum("_rows").over(ahead), "_before": F.sum("_sum").over(ahead)}).where("_parts > 1")
    offsets = F.broadcast(several.select(F.col("part").alias("_part"), *(F.col(c).alias(f"_{c}") for c in by), "_n", "_before"))
    inside = Window.partitionBy("part", *by).orderBy(*order)
    own = dealt.withColumns({"_i": F.row_number().over(inside) - 1, "_own": F.coalesce(F.sum("_cost").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    on = reduce(Column.__and__, ((own[c].eqNullSafe(offsets[f"_{c}"])) for c in by), own["part"] == offsets["_part"])
    found = own.join(offsets, on, "left")
    return found.select(*rows.columns, (F.coalesce("_n", F.lit(0)) + F.col("_i")).alias("n"), (F.coalesce("_before", F.lit(0)) + F.col("_own")).alias("before"), "part", F.col("_part").isNotNull().alias("cut"))


def _next(before: np.ndarray, cost: np.ndarray, most: int) -> np.ndarray:
    """Where the batch after the one that begins at each row begins: the first row
    that would lift it above ``most``, once it has any cost."""
    return np.maximum(np.searchsorted(before + cost, before + most, "right"), np.searchsorted(before, before, "right"))


def _last_start(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last batch start of the part, how many starts) on the way from each row,
    by doubling the steps."""
    here = np.arange(len(after))
    to, steps = np.where(after < len(after), after, here), (after < len(after)).astype(np.int64)
    while True:
        further = to[to]
        if (further == to).all():
            return to, steps + 1
        steps, to = steps + steps[to], further


def _keys(table: pa.Table, by: str) -> Iterator[tuple[object, int, int]]:
    """(key, first, end) of the runs of rows of a sorted table."""
    keys = table.column(by).combine_chunks()
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if len(keys) else np.zeros(0, int)
    at = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if a < b:
            yield keys[a].as_py(), a, b


def greedy_starts(rows: DataFrame, most: int, by: str, order: str, cost: str) -> DataFrame:
    """(by, order, batch): rows of a key in order join a batch, from 0, while its
    cost stays within ``most``; a costlier row is a batch of its own.

    Each row's next batch start is a search in the running sum; starts are those
    reached from a key's first row.  Within a part they are found by doubling.
    For a key that is cut, a part says where each row that may be its last start
    leads in the next part: a small table, along which one pass finds the row
    that does.  Tasks hold a part's numbers, no texts.
    """
    r = running(rows.select(by, order, F.coalesce(F.col(cost).cast("long"), F.lit(0)).alias("cost")), [by], [order], "cost")
    key_type, order_type = rows.schema[by].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    cut = r.where("cut")
    ends = cut.groupBy("part", by).agg(F.min("n").alias("first"), F.max(F.col("before") + F.col("cost")).alias("end"))
    tail_schema = f"part int, `{by}` {key_type}, start long, before long, root boolean, starts long"

    def numbers(table: pa.Table, a: int, b: int) -> tuple[np.ndarray, ...]:
        return tuple(table.column(c).to_numpy()[a:b] for c in ("n", "before", "cost"))

    def tails(table: pa.Table) -> pa.Table:
        """Rows that may be the last start of their part; root: it is reached."""
        table, out = table.sort_by([(by, "ascending"), ("n", "ascending")]), []
        for key, a, b in _keys(table, by):
            n, before, c = numbers(table, a, b)
            after = _next(before, c, most)
            last, starts = _last_start(after)
            for i in np.flatnonzero(after >= len(n)).tolist():
                root = bool(n[0] == 0 and last[0] == i)
                out.append((table.column("part")[a].as_py(), key, int(n[i]), int(before[i]), root, int(starts[0]) if root else 0))
        return _table(out, tail_schema, table.schema, by)

    edge_schema = f"part int, `{by}` {key_type}, start long, entry long, leads long, starts long"

    def edges(table: pa.Table, asked: pa.Table) -> pa.Table:
        """Where batches that began in parts before are followed in this one."""
        table, out = table.sort_by([(by, "ascending"), ("n", "ascending")]), []
        questions: dict = {}
        for q in asked.to_pylist():
            questions.setdefault(q["key"], []).append(q)
        for key, a, b in _keys(table, by):
            n, before, c = numbers(table, a, b)
            last, starts = _last_start(_next(before, c, most))
            for q in questions.get(key, []):
                j = max(int(np.searchsorted(before + c, q["before"] + most, "right")), int(np.searchsorted(before, q["before"], "right")))
                if j < len(n):
                    out.append((q["to"], key, q["start"], int(n[j]), int(n[last[j]]), int(starts[j])))
        return _table(out, edge_schema, table.schema, by)

    tail = cut.groupBy("part").applyInArrow(tails, tail_schema)
    later = F.broadcast(ends.select(F.col("part").alias("to"), F.col(by).alias("_key"), "end"))
    ahead = F.col(by).eqNullSafe(F.col("_key")) & (F.col("to") > F.col("part")) & (F.col("end") > F.col("before") + most)
    asked = tail.join(later, ahead).groupBy("part", by, "start", "before").agg(F.min("to").alias("to"))
    found = cut.groupBy("part").cogroup(_anew(asked, "to", key=by, start="start", before="before").groupBy("to")).applyInArrow(edges, edge_schema)
    roots = tail.where("root").select("part", by, F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("entry"), F.col("start").alias("leads"), "starts")

    def follow(state, row):
        at, count = state
        if row.start != at:
            return state, (False, count)
        return (row.leads, count + row.starts), (True, count)

    path = ordered_fold(roots.unionByName(found), [by], ["part", "start"], "hit boolean, earlier long", lambda: (-1, 0), follow)
    hits = path.where("hit").select(F.col("part").alias("_part"), F.col(by).alias("_key"), "entry", "earlier", "starts")
    so_far = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    met = ends.select("part", by).join(hits, (F.col("part") == F.col("_part")) & F.col(by).eqNullSafe(F.col("_key")), "left").drop("_part", "_key")
    entries = met.withColumn("upto", F.coalesce(F.max(F.col("earlier") + F.col("starts")).over(so_far), F.lit(0)))
    batch_schema = f"`{by}` {key_type}, `{order}` {order_type}, batch int"

    def batches(table: pa.Table, known: pa.Table) -> pa.Table:
        table = table.sort_by([(by, "ascending"), ("n", "ascending")])
        entry = {x["key"]: x for x in known.to_pylist()}
        batch = np.zeros(table.num_rows, np.int64)
        for key, a, b in _keys(table, by):
            n, before, c = numbers(table, a, b)
            x = entry.get(key, {"entry": 0, "upto": 0, "earlier": 0})
            if x["entry"] is None:
                batch[a:b] = x["upto"] - 1
                continue
            after = _next(before, c, most)
            begins, i = np.zeros(len(n), bool), int(x["entry"] - n[0])
            while i < len(n):
                begins[i] = True
                i = int(after[i])
            batch[a:b] = x["earlier"] - 1 + np.cumsum(begins)
        return pa.table([table.column(by), table.column(order), pa.array(batch.astype(np.int32))], [by, order, "batch"])

    return r.groupBy("part").cogroup(_anew(entries, "part", key=by, entry="entry", earlier="earlier", upto="upto").groupBy("to")).applyInArrow(batches, batch_schema)


def _anew(df: DataFrame, part: str, **columns: str) -> DataFrame:
    """Columns under names and identities of their own, to be grouped beside the
    rows that they came from."""
    return df.select(F.col(part).alias("to"), *(F.col(c).alias(name) for name, c in columns.items()))


def _table(rows: list[tuple], schema: str, like: pa.Schema, by: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    names = [f.strip("`") for f, _ in fields]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(list(c), like.field(by).type if n == by else types[t]) for c, n, (_, t) in zip(columns, names, fields, strict=True)], names)
