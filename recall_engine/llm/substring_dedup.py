"""Removal of word passages seen in earlier documents, by fixed-block anchors."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.repeats import CONTEXT, Group, Read, Units, context_rows, least_grams, repeated_windows, runs, with_spans
from recall_engine.llm.stage import discard, join_hot, keyed, public_id, written
from recall_engine.llm.textcols import Words, prefix_hash, slices, span_hash


def _read(column: pa.Array) -> Read:
    w = Words(column)
    joined = cache(w.joined)

    def content(a: int, b: int) -> bytes:
        whole, start, end = joined()
        return whole[start[a] : end[b - 1]]

    return Read(prefix_hash(w.rolling()), w.first, content)


def _regions(rows: DataFrame, units: Units) -> DataFrame:
    """(key, id, text, regions) of the documents that may share a window.

    Equal windows have equal least grams, so windows whose least gram is in one
    document only can be left out: regions are the stretches of the others."""

    def run(batches):
        for batch in slices(batches):
            read = units.read(batch.column(2))
            first, count, _, h = runs(least_grams(read, units), None, read.offsets, units)
            owner = np.searchsorted(read.offsets, first, "right") - 1
            start = first - read.offsets[owner]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(start), pa.array(start + count + units.window - 1)], ["key", "id", "h", "start", "end"])

    found = written(rows.mapInArrow(run, "key long, id long, h long, start long, end long"), "least-grams")
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    again = written(counts.where(F.col("a") < F.col("b")).select("h", "n"), "anchors")
    stretches = join_hot(found, again.select("h"), ["h"], again, found.count()).select("key", "id", "start", "end")
    out = written(with_spans(rows, stretches).where(F.col("spans").isNotNull()).dropDuplicates(["key", "id"]).withColumnRenamed("spans", "regions"), "regions")
    discard(found, again)
    return out


def block_hits(docs: DataFrame, units: Units, block: int) -> DataFrame:
    """(key, id, hits) for docs with ``regions``: hits (place, g) are the rolling
    windows of ``block`` words that equal a reference block and that more than
    one document has.

    Reference blocks stand side by side in every region; they are indexed by
    their hash, and every rolling window of as many words probes the index.
    """

    def run(batches):
        for batch in slices(batches):
            read = units.read(batch.column(2))
            regions = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(regions.offsets)))
            flat = regions.flatten()
            low = np.asarray(flat.field(0)) + read.offsets[owner]
            size = np.asarray(flat.field(1)) + read.offsets[owner] - block + 1 - low
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(low, size) + within
            g = span_hash(read.prefix, at, at + block).view(np.int64)
            of = pa.array(np.repeat(owner, size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(at - np.repeat(read.offsets[owner], size)), pa.array(g), pa.array(within % block == 0)], ["key", "id", "place", "g", "reference"])

    probes = written(docs.select("key", "id", "text", "regions").mapInArrow(run, "key long, id long, place long, g long, reference boolean"), "probes")
    counts = probes.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), F.max("reference").alias("reference"))
    index = written(counts.where(F.col("reference") & (F.col("a") < F.col("b"))).select("g", "n"), "block-index")
    hits = join_hot(probes.drop("reference"), index.select("g"), ["g"], index, probes.count())
    out = written(hits.groupBy("key", "id").agg(F.collect_list(F.struct("place", "g")).alias("hits")), "block-hits")
    discard(probes, index)
    return out


def _contexts_of_hits(docs: DataFrame, hits: DataFrame, units: Units) -> DataFrame:
    """CONTEXT of the windows that hold a hit, each run of windows by its least one."""

    def run(batches):
        for batch in slices(batches):
            read = units.read(batch.column(2))
            found = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(found.offsets)))
            flat = found.flatten()
            at = np.asarray(flat.field(0)) + read.offsets[owner]
            grams = np.zeros(max(int(read.offsets[-1]) - units.gram + 1, 0), np.uint64)
            chosen = np.zeros(len(grams), bool)
            grams[at], chosen[at] = np.asarray(flat.field(1)).view(np.uint64), True
            yield context_rows(batch, read, runs(grams, chosen, read.offsets, units), units.window)

    return docs.join(hits, ["key", "id"]).select("key", "id", "text", "hits").mapInArrow(run, CONTEXT)


def extended_hits(words: np.ndarray, first: np.ndarray, group: np.ndarray, windows: np.ndarray, at: np.ndarray, ids: np.ndarray, window: int, block: int) -> np.ndarray:
    """Flags the windows of each context that a context of its group with a
    smaller id has too.

    All contexts of a group hold a block at their place ``at``.  From there they
    are extended to both sides, a word at a time: contexts stay in one class
    while their words (numbers, equal only for equal words) are equal.  A window
    repeats where both its left and its right part do, in one context: the
    windows that touch make up the maximal repeats.
    """
    count = len(first) - 1
    who = np.arange(count)
    size = np.diff(first)

    def split(labels: np.ndarray, have: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Classes one word further; -1 where a context ends."""
        have = have & (labels >= 0)
        out = np.full(count, -1, np.int64)
        if have.any():
            out[have] = np.unique((labels[have] << 32) | words[place[have]], return_inverse=True)[1]
        return out

    start = np.unique(group, return_inverse=True)[1].astype(np.int64)
    right, left = [start], [start]
    for k in range(window):
        right.append(split(right[-1], at + k < size, np.minimum(first[:-1] + at + k, len(words) - 1)))
    for k in range(1, window - block + 1):
        left.append(split(left[-1], at >= k, np.maximum(first[:-1] + at - k, 0)))
    ends = np.cumsum(windows)
    flags = np.zeros(int(ends[-1]) if count else 0, bool)
    for k in range(window - block + 1):  # words of the window before the block
        have = who[(at - k >= 0) & (at - k < windows) & (left[k] >= 0) & (right[window - k] >= 0)]
        if not len(have):
            continue
        _, place = np.unique((left[k][have] << 32) | right[window - k][have], return_inverse=True)
        least = np.full(place.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, place, ids[have])
        later = have[least[place] < ids[have]]
        flags[(ends - windows)[later] + at[later] - k] = True
    return flags


def _compare(window: int, block: int):
    def compare(g: Group) -> np.ndarray:
        column = pa.Array.from_buffers(pa.large_binary(), len(g.h), [None, pa.py_buffer(g.offset.astype(np.int64)), pa.py_buffer(g.text)])
        w = Words(column)
        return extended_hits(w.numbers(), w.first, g.h, g.windows.astype(np.int64), g.at.astype(np.int64), g.least_id, window, block)

    return compare


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, text, spans) for every row: the word stretches covered by a
    ``window``-word window that also starts in a document of a smaller id.

    Half a window long blocks of words, side by side, are the reference; rolling
    windows of as many words probe them (block_hits).  Every window holds a
    whole block of each document that has it, so nothing is missed.  Windows
    around a hit are contexts of the least hit in them, and contexts of one hit
    are extended word by word (extended_hits).

    Words are [^\\x20\\x09-\\x0D]+, unchanged; windows are judged on the input.
    Null text has no words, texts of fewer words than a window have no spans,
    long ones are read whole; a null id is smaller than all others; documents
    of equal id, repeated rows among them, don't count as earlier; an empty
    table gives no rows; other columns go.
    """
    rows = keyed(docs, id_col, text_col)
    block = (window + 1) // 2
    held = _regions(rows, Units(window, max(1, min(8, block)), _read))
    units = Units(window, block, _read)
    every = written(_contexts_of_hits(held, block_hits(held, units, block), units), "contexts")
    return with_spans(rows, repeated_windows(every, held, units, _compare(window, block), later_only=True))


def cut_words(marked: DataFrame) -> DataFrame:
    """(doc_id, key, kept, n_words, n_removed): the words outside of the spans,
    joined by one space; a row for each row of substring_dedup, whatever the
    length of its text."""

    def run(batches):
        for batch in slices(batches):
            w = Words(batch.column(2))
            spans = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(spans.offsets)))
            flat = spans.flatten()
            edge = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(edge, np.asarray(flat.field(0)) + w.first[owner], 1)
            np.add.at(edge, np.asarray(flat.field(1)) + w.first[owner], -1)
            stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            # a word that another one follows keeps the byte behind it, as a space
            follows = w.end[stay[:-1][w.row[stay[1:]] == w.row[stay[:-1]]]]
            hold = np.zeros(len(w.raw) + 1, np.int8)
            hold[w.start[stay]] = 1
            hold[w.end[stay]] -= 1
            held = np.cumsum(hold[:-1], dtype=np.int8) > 0
            held[follows] = True
            raw = w.raw.copy()
            raw[follows] = 0x20
            ends = np.concatenate([[0], np.cumsum(held)])[w.offsets]
            kept = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[held])]).cast(pa.string())
            gone = w.count - np.bincount(w.row[stay], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept, pa.array(w.count.astype(np.int64)), pa.array(gone.astype(np.int64))], ["key", "doc_id", "kept", "n_words", "n_removed"])

    return marked.select("key", "id", "text", "spans").mapInArrow(run, "key long, doc_id long, kept string, n_words long, n_removed long").withColumn("doc_id", public_id("doc_id"))
