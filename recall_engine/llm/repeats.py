"""What substring dedup operators share: finding repeated windows at scale.

A window is a fixed number of units (bytes or words) of one document.  Windows
are assigned to anchors, short strings within them, by content alone.  Equal
windows have equal anchors at equal places, so

* each run of windows with one anchor (a context) is one row with the digest of
  the context, about one for 170 bytes or 12 words;
* only anchors that come twice can hold repeated windows;
* copies of one context travel as one row that counts them;
* each context, with its text, meets the different contexts of its anchor, and
  there the operator's own method compares windows;
* anchors with very many different contexts (the edges of a passage that is in
  very many documents) are cut into single windows, which are counted.

Nothing emits pairs, and no group's rows are held for its key alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.llm.stage import discard, join_hot, written
from recall_engine.llm.textcols import slices, span_hash, window_min

@dataclass
class Read:
    """The units of a text column: prefix hashes, unit offsets of the rows and
    their bytes."""

    prefix: np.ndarray
    offsets: np.ndarray
    #: content(a, b): bytes of units a..b; words are joined by one space.
    content: Callable[[int, int], bytes]

    def digest(self, a: int, b: int) -> bytes:
        """xxh3-128 of units a..b."""
        return xxhash.xxh3_128_digest(self.content(a, b))


@dataclass(frozen=True)
class Units:
    """How a text column is read, in windows of ``window`` units."""

    window: int
    gram: int
    read: Callable[[pa.Array], Read]
    #: Anchors with more different contexts are cut into single windows.
    most_contexts: int = 2_000
    #: Context bytes that are compared in one go.
    group_bytes: int = 4 << 20


@dataclass
class Group:
    """Contexts of whole anchors: their bytes one after another, the number of
    copies and the least id of each."""

    text: np.ndarray
    offset: np.ndarray
    h: np.ndarray
    windows: np.ndarray
    at: np.ndarray
    least_id: np.ndarray
    copies: np.ndarray


def least_grams(read: Read, units: Units) -> np.ndarray:
    """For every place, the 64-bit hash of the gram that starts there."""
    n = int(read.offsets[-1])
    return span_hash(read.prefix, np.arange(n - units.gram + 1), np.arange(units.gram, n + 1)) if n >= units.gram else np.zeros(0, np.uint64)


def runs(grams: np.ndarray, chosen: np.ndarray | None, offsets: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor, anchor hash) of every run.

    A window's anchor is the leftmost of its least grams, among those chosen;
    windows without any have none."""
    width = units.window - units.gram + 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(grams) < width:
        return empty
    top = np.uint64(0xFFFFFFFF << 32)
    rank = (grams & top) | np.arange(len(grams), dtype=np.uint64)
    if chosen is not None:
        rank = np.where(chosen, rank, np.uint64(0xFFFFFFFFFFFFFFFF))
    least = window_min(rank, width)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    valid = np.flatnonzero((np.arange(len(least)) + units.window <= end) & (least != np.uint64(0xFFFFFFFFFFFFFFFF)))
    if not len(valid):
        return empty
    anchor = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(valid) != 1)) + 1
    first = np.concatenate([[0], cut])
    count = np.diff(np.concatenate([first, [len(valid)]]))
    return valid[first], count, anchor[first], grams[anchor[first]]


CONTEXT = "key long, id long, h long, c1 long, c2 long, start long, windows int, at int"


def context_rows(batch: pa.RecordBatch, read: Read, found: tuple[np.ndarray, ...], window: int) -> pa.RecordBatch:
    """Rows of CONTEXT for the runs found in a batch (key, id, ...): start counts
    units in the document, at is the anchor's place in the run, c1 and c2 are
    the digest."""
    first, count, anchor, h = found
    owner = np.searchsorted(read.offsets, first, "right") - 1
    digest = np.frombuffer(b"".join([read.digest(a, b) for a, b in zip(first.tolist(), (first + count + window - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
    columns = [batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
    columns += [pa.array((first - read.offsets[owner]).astype(np.int64)), pa.array(count.astype(np.int32)), pa.array((anchor - first).astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["key", "id", "h", "c1", "c2", "start", "windows", "at"])


def contexts(rows: DataFrame, units: Units) -> DataFrame:
    """CONTEXT for all windows of rows (key, id, text): any gram may be an anchor."""

    def run(batches):
        for batch in slices(batches):
            read = units.read(batch.column(2))
            yield context_rows(batch, read, runs(least_grams(read, units), None, read.offsets, units), units.window)

    return rows.mapInArrow(run, CONTEXT)


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, cut between anchors at about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "content", limit):
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h = np.asarray(whole.column(0))
        last = np.flatnonzero(h != h[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield whole.slice(0, cut)
        held, size = [whole.slice(cut)], whole.slice(cut).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _spans(flags: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, end) of the runs of set flags; flags lie context by context."""
    edge = np.zeros(len(flags), bool)
    ends = np.cumsum(windows)
    edge[ends - windows] = True
    on = np.flatnonzero(flags & (edge | ~np.concatenate([[False], flags[:-1]])))
    last = np.concatenate([edge[1:], [True]])
    off = np.flatnonzero(flags & (last | ~np.concatenate([flags[1:], [False]])))
    owner = np.searchsorted(ends, on, "right")
    base = (ends - windows)[owner]
    return owner, on - base, off - base + 1


_PIECE = {"h": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "least_id": pa.int64(), "copies": pa.int64(), "windows": pa.int32(), "at": pa.int32(), "content": pa.binary(), "w1": pa.int64(), "w2": pa.int64(), "place": pa.int32()}
_PIECE_SCHEMA = "h long, c1 long, c2 long, least_id long, copies long, windows int, at int, content binary, w1 long, w2 long, place int"


def _joined(single: DataFrame, same: list[str]) -> DataFrame:
    """(*same, first, last): the runs that single windows of a context make side
    by side, so that each copy of it later gets a row a run, not a window."""
    run = F.col("place") - F.row_number().over(Window.partitionBy(*same).orderBy("place"))
    runs = single.select(*same, "place", run.alias("run")).groupBy(*same, "run")
    return runs.agg(F.min("place").cast("long").alias("first"), (F.max("place") + 1).cast("long").alias("last")).drop("run")


def repeated_windows(every: DataFrame, docs: DataFrame, units: Units, compare: Callable[[Group], np.ndarray], *, later_only: bool) -> DataFrame:
    """(key, id, start, end) in units: stretches covered by repeated windows.

    every: written rows of CONTEXT; docs: rows (key, id, text) that hold them.
    later_only: a window counts where it also starts in a document of a smaller
    id; else where it starts anywhere else.  ``compare`` gets whole anchors and
    flags each of their windows, context by context.
    """
    by_anchor = every.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    again = written(by_anchor.where(F.col("a") < F.col("b") if later_only else F.col("n") > 1).select("h", "n"), "anchors")
    total = every.count()
    found = written(join_hot(every, again.select("h"), ["h"], again, total), "repeated-anchors")
    same = ["h", "c1", "c2"]
    of = found.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"), F.max("id").alias("most_id"), F.min(F.struct("key", "id", "start", "windows", "at")).alias("x"))
    of = written(of.select(*same, "copies", "least_id", "most_id", "x.*"), "different-contexts")
    discard(every)
    width = units.window - 1

    kinds = of.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    wanted = of.join(kinds.where(F.col("kinds") > 1) if later_only else kinds, "h")
    wanted = wanted.groupBy("key", "id").agg(F.collect_list(F.struct("h", "c1", "c2", "least_id", "copies", "windows", "at", "start", "kinds")).alias("wanted"))
    limit = units.most_contexts

    def cut(batches):
        for batch in slices(batches):
            read = units.read(batch.column(0))
            asked = batch.column(1)
            x = pa.RecordBatch.from_struct_array(asked.flatten())
            low = np.asarray(x.column("start")) + np.repeat(read.offsets[:-1], np.diff(np.asarray(asked.offsets)))
            windows = np.asarray(x.column("windows")).astype(np.int64)
            few = np.asarray(x.column("kinds")) <= limit

            def table(of, **more):
                head = x.take(pa.array(of))
                return pa.RecordBatch.from_arrays([head.column(c) if c in head.schema.names else pa.array(more[c], t) if c in more else pa.nulls(len(of), t) for c, t in _PIECE.items()], [*_PIECE])

            whole = np.flatnonzero(few)
            for i in range(0, len(whole), 5_000):
                of = whole[i : i + 5_000]
                yield table(of, content=[read.content(a, b) for a, b in zip(low[of].tolist(), (low + windows + width)[of].tolist(), strict=True)])
            many = np.flatnonzero(~few)
            ends = np.cumsum(windows[many])
            for i in range(0, int(ends[-1]) if len(many) else 0, 5_000):
                row = np.arange(i, min(i + 5_000, int(ends[-1])))
                k = np.searchsorted(ends, row, "right")
                of, place = many[k], row - (ends[k] - windows[many[k]])
                digest = np.frombuffer(b"".join([read.digest(a, a + units.window) for a in (low[of] + place).tolist()]), np.int64).reshape(-1, 2)
                yield table(of, w1=digest[:, 0], w2=digest[:, 1], place=place.astype(np.int32))

    pieces = written(docs.join(wanted, ["key", "id"]).dropDuplicates(["key", "id"]).select("text", "wanted").mapInArrow(cut, _PIECE_SCHEMA), "context-texts")

    def meet(batches):
        for batch in _groups(batches, units.group_bytes):
            content = batch.column(batch.schema.get_field_index("content"))
            offset = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(content), np.int64))])
            text = np.frombuffer(b"".join(content.to_pylist()), np.uint8)
            h, windows, at, least, copies = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("h", "windows", "at", "least_id", "copies"))
            owner, first, end = _spans(compare(Group(text, offset, h, windows, at, least, copies)), windows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(owner)) for k in range(3)), pa.array(first.astype(np.int64)), pa.array(end.astype(np.int64))], [*same, "first", "last"])

    few = pieces.where(F.col("content").isNotNull()).select("h", "c1", "c2", "least_id", "copies", "windows", "at", "content")
    inside = few.repartition("h").sortWithinPartitions("h", "c1", "c2").mapInArrow(meet, "h long, c1 long, c2 long, first long, last long")
    many = pieces.where(F.col("content").isNull()).select(*same, "least_id", "copies", "w1", "w2", "place")
    seen = many.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("k"), F.min("least_id").alias("m"), F.max("least_id").alias("most"))
    twice = seen.where(F.col("m") < F.col("most") if later_only else F.col("k") > 1).select("w1", "w2", "m")
    single = join_hot(many, twice, ["w1", "w2"], seen, total)
    if later_only:
        single = single.where(F.col("m") < F.col("least_id"))
    flagged = written(inside.unionByName(_joined(single, same)), "repeated-windows")
    sizes = of.select(*same, F.col("copies").alias("n"))
    spot = lambda x: x.select("key", "id", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + width).alias("end"))
    if not later_only:
        return spot(join_hot(found, flagged, same, sizes, total))
    # what copies of a context in later documents hold comes earlier, all of it
    copied = of.where(F.col("least_id") < F.col("most_id")).select(*same, "least_id")
    whole = join_hot(found, copied, same, sizes, total).where(F.col("id") > F.col("least_id"))
    whole = whole.select("key", "id", "start", (F.col("start") + F.col("windows") + width).alias("end"))
    return whole.unionByName(spot(join_hot(found, flagged.join(of.select(*same, "least_id"), same), same, sizes, total).where(F.col("id") == F.col("least_id"))))


def gathered(spans: DataFrame) -> DataFrame:
    """(key, id, spans): each document's stretches (start, end), merged and in order."""
    order = Window.partitionBy("key", "id").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    run = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.distinct().withColumn("reach", reach).withColumn("run", run).groupBy("key", "id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs and their ``spans``; null where there are none."""
    return docs.join(gathered(spans), ["key", "id"], "left")
