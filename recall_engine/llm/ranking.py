"""Ranked lexical search by Block-Max MaxScore over document shards.

An index is a table of posting lists.  Each scan task cuts its documents into
shards of bounded text; a shard numbers its documents in ascending id order and
holds, for each of its terms, a list of compressed blocks of up to 128 postings.
Every block keeps the pairs (tf, length) that no other pair of the block
dominates, so its largest score follows exactly from whatever N, L and weights
hold at search time, and shards can be added without touching others.

A search scores every shard by itself: the lists whose bounds together can't
lift a document above the k-th best so far are non-essential; candidates come
from the others, and block maxima of the non-essential lists reject them before
those blocks are decompressed.  The shards' k best are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.llm.stage import NULL_ID, discard, keyed, public_id, written
from recall_engine.llm.textcols import NOT_TERM, SLICE_BYTES, Words, stretches

BLOCK = 128
#: Text bytes a shard takes; a longer document is a shard of its own.
SHARD_BYTES = 16 << 20
#: Items that one task scores together, text bytes of theirs, and such blocks of
#: items that one pass over the index takes: what a pass broadcasts is bounded.
BLOCK_ITEMS, BLOCK_BYTES, PASS_BLOCKS = 256, 1 << 20, 8
#: Documents that are scored before the threshold is looked at again; the first
#: time it is a quarter.
WINDOW_DOCS = 2048

INDEX_SCHEMA = "shard long, term string, df long, total long, blocks binary, tops binary, postings binary"
_WIDTHS = [np.uint8, np.uint16, np.uint32]


@dataclass(frozen=True)
class Scoring:
    """A document's length counts as m = 100 - length + (length*n*N) div L, and a
    term as w * ((10^9*tf) div (1000*tf + saturation*m)), all in integers."""

    saturation: int = 8
    length: int = 90

    def impact(self, tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
        tf, n = tf.astype(np.int64), n.astype(np.int64)
        m = 100 - self.length + (self.length * n * docs) // terms
        return (1_000_000_000 * tf) // (1000 * tf + self.saturation * m)


class _Shard:
    """Documents of one shard while they are read."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.docs = self.size = 0
        self.doc: list[np.ndarray] = []
        self.word: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        self.words: list[bytes] = []

    def add(self, words: Words, ids: np.ndarray, more: bool) -> None:
        """Terms of rows; ``more``: the first row goes on from the call before."""
        first = self.docs - more
        numbers, different = words.known()
        pairs, counts = np.unique((words.row + first << 32) | (numbers + len(self.words)), return_counts=True)
        self.doc.append((pairs >> 32).astype(np.int32))
        self.word.append((pairs & 0xFFFFFFFF).astype(np.int32))
        self.count.append(counts)
        self.words += different
        self.ids.append(ids[more:])
        self.docs = first + len(ids)
        self.size += len(words.raw)

    def rows(self, shard: int) -> pa.RecordBatch | None:
        """The shard's index rows: that of the documents (term '') first."""
        doc, count = np.concatenate(self.doc), np.concatenate(self.count)
        terms = pa.array(self.words, pa.large_binary()).dictionary_encode()
        if not len(doc):
            return None
        word = terms.indices.to_numpy(zero_copy_only=False)[np.concatenate(self.word)]
        # terms in order of their bytes, documents in order of their ids
        by_bytes = pc.sort_indices(terms.dictionary).to_numpy()
        place = np.empty(len(by_bytes), np.int64)
        place[by_bytes] = np.arange(len(by_bytes))
        used = np.bincount(doc, minlength=self.docs) > 0
        ids = np.concatenate(self.ids)
        by_id = np.flatnonzero(used)[np.argsort(ids[used], kind="stable")]
        number = np.zeros(self.docs, np.int64)
        number[by_id] = np.arange(len(by_id))
        key = (place[word] << 32) | number[doc]
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        tf = np.add.reduceat(count, np.flatnonzero(new))
        key = key[new]
        term, doc = key >> 32, key & 0xFFFFFFFF
        length = np.bincount(doc, tf, len(by_id)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(by_bytes)))])
        blocks, tops, postings = _compressed(at, doc, tf, length[doc])
        heads = [pa.array([len(by_id)], pa.int64()), pa.array([length.sum()], pa.int64()), pa.array([b""], pa.binary()), pa.array([length.tobytes()], pa.binary()), pa.array([ids[by_id].tobytes()], pa.binary())]
        lists = [pa.array(np.diff(at)), pa.array(np.zeros(len(by_bytes), np.int64)), blocks, tops, postings]
        names = terms.dictionary.take(pa.array(by_bytes)).cast(pa.large_string()).cast(pa.string())
        columns = [pa.concat_arrays([a, b]) for a, b in zip([pa.array([""]), *heads], [names, *lists], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(by_bytes) + 1, shard)), *columns], ["shard", "term", "df", "total", "blocks", "tops", "postings"])


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _compressed(at: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(blocks, tops, postings) of lists at[i]:at[i + 1] of ascending documents.

    blocks: int32 rows (last document, size and widths, first posting byte,
    first top); tops: uint32 pairs (tf, n) that no pair of the block dominates;
    postings: per block the gaps to the document before, then the tfs, each in
    the least width of 1, 2 or 4 bytes that holds them.
    """
    size = np.diff(at)
    inside = np.arange(len(doc)) - np.repeat(at[:-1], size)
    starts = np.flatnonzero(inside % BLOCK == 0)
    counts = np.diff(np.append(starts, len(doc)))
    block = np.repeat(np.arange(len(starts)), counts)
    gap = np.diff(doc, prepend=0)
    gap[at[:-1]] = doc[at[:-1]]
    widths = [np.searchsorted([1 << 8, 1 << 16], np.maximum.reduceat(x, starts), "right") for x in (gap, tf)]
    sizes = counts * sum(1 << w for w in widths)
    first = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    rank = np.arange(len(doc)) - starts[block]
    base = first
    for values, width in zip((gap, tf), widths, strict=True):
        place = base[block] + (rank << width[block])
        for w in range(3):
            those = width[block] == w
            for byte in range(1 << w):
                out[place[those] + byte] = (values[those] >> (8 * byte)) & 255
        base = base + (counts << width)
    # the pairs that are not dominated: by n, only those whose tf exceeds all before
    order = np.lexsort([-tf, n, block])
    high = (block[order] << 32) | tf[order]
    top = np.concatenate([[True], high[1:] > np.maximum.accumulate(high)[:-1]])
    kept = order[top]
    pairs = np.stack([tf[kept], n[kept]], 1).astype(np.uint32)
    tops = np.bincount(block[kept], minlength=len(starts))
    list_of = np.repeat(np.arange(len(size)), size)[starts]
    own = np.searchsorted(list_of, np.arange(len(size) + 1))
    byte_at, top_at = np.append(first, len(out))[own], np.append(np.cumsum(tops) - tops, len(kept))[own]
    meta = np.stack([doc[starts + counts - 1], counts | widths[0] << 16 | widths[1] << 20, first - byte_at[list_of], np.cumsum(tops) - tops - top_at[list_of]], 1).astype(np.int32)
    return _binaries(meta.reshape(-1).view(np.uint8), own[1:] * 16), _binaries(pairs.reshape(-1).view(np.uint8), top_at[1:] * 8), _binaries(out, byte_at[1:])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all documents, INDEX_SCHEMA, as a table in the shared folder.

    Terms are the maximal runs of letters, digits and other characters than
    ASCII in whole texts, A-Z in lower case.  Documents without a term (null and
    empty texts) aren't in it; repeated rows and rows of one id are documents of
    their own; a null id comes before all others.  Texts of any length are read
    in stretches.  An empty table gives an index without rows; other columns are
    not read.  Nothing is shuffled: a shard is a part of one scan task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard, more = TaskContext.get().partitionId(), 0, _Shard(), False
        for batch, text, ends in stretches(batches, NOT_TERM, limit=min(SLICE_BYTES, shard_bytes)):
            shard.add(Words(text, lower=True, separator=NOT_TERM), batch.column(0).to_numpy(), more)
            more = not ends
            if shard.size >= shard_bytes and ends:
                if (rows := shard.rows(part << 24 | made)) is not None:
                    yield rows
                made, shard = made + 1, _Shard()
        if shard.docs and (rows := shard.rows(part << 24 | made)) is not None:
            yield rows

    return written(keyed(docs, id_col, text_col).select("id", "text").mapInArrow(run, INDEX_SCHEMA), "postings")


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term), once each."""

    def run(batches):
        for batch, text, _ in stretches(batches, NOT_TERM):
            words = Words(text, lower=True, separator=NOT_TERM)
            numbers, different = words.known()
            pairs = np.unique((words.row << 32) | numbers)
            ids = batch.column(0).take(pa.array(pairs >> 32))
            yield pa.RecordBatch.from_arrays([ids, pa.array(different, pa.binary()).take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string())], ["item", "term"])

    return keyed(items, id_col, text_col).select("id", "text").mapInArrow(run, "item long, term string").distinct()


class _List:
    """A posting list whose blocks are decompressed when they are asked for."""

    def __init__(self, df: int, blocks: bytes, tops: bytes, postings: bytes, lengths: np.ndarray, impact):
        meta = np.frombuffer(blocks, np.int32).reshape(-1, 4)
        self.last, self.kind, self.byte, top = meta.T
        self.postings, self.lengths, self.impact = postings, lengths, impact
        pairs = np.frombuffer(tops, np.uint32).reshape(-1, 2)
        self.most = np.maximum.reduceat(impact(pairs[:, 0], pairs[:, 1]), top)
        self.bound = int(self.most.max())
        # the places of blocks not decompressed yet hold their last document
        self.docs = np.repeat(self.last, self.kind & 0xFFFF)
        self.impacts = np.zeros(df, np.int64)
        self.known = np.zeros(len(self.last), bool)

    def need(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.known[blocks]].tolist():
            kind, at = int(self.kind[b]), int(self.byte[b])
            n, gap, tf = kind & 0xFFFF, _WIDTHS[kind >> 16 & 15], _WIDTHS[kind >> 20]
            place = slice(b * BLOCK, b * BLOCK + n)
            gaps = np.frombuffer(self.postings, gap, n, at)
            self.docs[place] = np.cumsum(gaps, dtype=np.int64) + (int(self.last[b - 1]) if b else 0)
            self.impacts[place] = self.impact(np.frombuffer(self.postings, tf, n, at + gaps.nbytes), self.lengths[self.docs[place]])
            self.known[b] = True


def best_of_shard(lists: list[tuple[_List, int]], docs: int, k: int, window: int = WINDOW_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """(document numbers, scores) of the k best of a shard for (list, weight)s:
    scores above 0, highest first, equal ones by ascending number."""
    lists = sorted(lists, key=lambda x: x[0].bound * x[1])
    bounds = np.cumsum([0, *(x.bound * w for x, w in lists)])
    best, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    at, span = 0, max(window // 4, 1)
    while at < docs:
        to = min(at + span, docs)
        # lists before `first` can't lift a document above the threshold by themselves
        first = int(np.searchsorted(bounds, threshold, "right")) - 1
        if first >= len(lists):
            break
        sums = np.zeros(to - at, np.int64)
        for x, w in lists[first:]:
            a, b = np.searchsorted(x.last, [at, to - 1])
            b = min(b + 1, len(x.last))
            if a < b:
                x.need(np.arange(a, b))
                found = x.docs[a * BLOCK : b * BLOCK]
                i, j = np.searchsorted(found, [at, to])
                sums[found[i:j] - at] += w * x.impacts[a * BLOCK + i : a * BLOCK + j]
        found = np.flatnonzero(sums)
        sums = sums[found]
        found = found + at
        for i in range(first - 1, -1, -1):
            x, w = lists[i]
            open_ = sums + bounds[i + 1] > threshold
            found, sums = found[open_], sums[open_]
            if not len(found):
                break
            block = np.searchsorted(x.last, found)
            inside = block < len(x.last)
            most = np.where(inside, w * x.most[np.minimum(block, len(x.last) - 1)], 0)
            open_ = sums + most + bounds[i] > threshold
            found, sums, block, inside = found[open_], sums[open_], block[open_], inside[open_]
            x.need(np.unique(block[inside]))
            place = np.minimum(np.searchsorted(x.docs, found), len(x.docs) - 1)
            sums += np.where(x.docs[place] == found, w * x.impacts[place], 0)
        open_ = sums > threshold
        best, scores = np.concatenate([best, found[open_]]), np.concatenate([scores, sums[open_]])
        order = np.lexsort([best, -scores])[:k]
        best, scores = best[order], scores[order]
        threshold = int(scores[-1]) if len(scores) == k else 0
        at, span = to, window
    return best, scores


def search(index: DataFrame, items: DataFrame, k: int = 10, scoring: Scoring = Scoring(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents above 0 of
    each item, equal scores by ascending doc_id, exactly.

    index: rows of build_index.  A term's weight is floor(1000 * ln((2N + 2) /
    (2df + 1))).  Items without a known term (null and empty texts) have no
    rows; rows of one item id are one item with all their terms; a null item id
    is an item too, other columns are not read.  A pass over the index takes
    PASS_BLOCKS blocks of items; each group of a shard and a block of items is
    scored by one task, which holds the shard's lists for those items' terms.
    """
    corpus = index.where("term = ''").agg(F.sum("df").alias("docs"), F.sum("total").alias("terms")).first()
    n, total = corpus["docs"] or 0, corpus["terms"] or 0
    wanted = written(_item_terms(items, id_col, text_col), "item-terms")
    size = wanted.agg(F.count_distinct("item").alias("items"), F.sum(F.octet_length("term") + 16).alias("bytes")).first()
    n_blocks = max(-(-size["items"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES), 1)
    blocked = wanted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int"))
    found = []
    for at in range(0, n_blocks, PASS_BLOCKS):
        those = blocked.where((F.col("block") >= at) & (F.col("block") < at + PASS_BLOCKS))
        df = index.select("term", "df").join(F.broadcast(those.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
        weighed = df.select("term", weight.alias("w")).where("w > 0")
        asked = written(those.join(weighed, "term").groupBy("block", "term").agg(F.collect_list(F.struct("item", "w")).alias("askers")), "asked")
        lists = index.join(F.broadcast(asked), "term")
        blocks = F.explode(F.sequence(F.lit(at), F.lit(min(at + PASS_BLOCKS, n_blocks) - 1)))
        heads = index.where("term = ''").withColumns({"block": blocks, "askers": F.lit(None).cast("array<struct<item:bigint,w:bigint>>")})
        columns = ["shard", "block", "term", "df", "tops", "blocks", "postings", "askers"]
        found.append(written(lists.select(columns).unionByName(heads.select(columns)).groupBy("shard", "block").applyInArrow(_scorer(n, total, k, scoring), "item long, doc long, score long"), "shard-best"))
        discard(asked)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    discard(wanted)
    return ranked.select(public_id("item").alias("item_id"), "rank", public_id("doc").alias("doc_id"), "score")


def _scorer(n: int, total: int, k: int, scoring: Scoring):
    """Scores the items of a block in a shard."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = table.to_pylist()
        head = next(r for r in rows if r["term"] == "")
        ids, lengths = np.frombuffer(head["postings"], np.int64), np.frombuffer(head["tops"], np.int64)
        impact = lambda tf, length: scoring.impact(tf, length, n, total)
        asked: dict[int, list[tuple[_List, int]]] = defaultdict(list)
        for r in rows:
            if r["askers"]:
                x = _List(r["df"], r["blocks"], r["tops"], r["postings"], lengths, impact)
                for asker in r["askers"]:
                    asked[asker["item"]].append((x, asker["w"]))
        out = [(item, *best_of_shard(lists, len(ids), k)) for item, lists in asked.items()]
        item = np.concatenate([np.full(len(d), i) for i, d, _ in out]) if out else []
        doc = ids[np.concatenate([d for _, d, _ in out])] if out else []
        score = np.concatenate([s for _, _, s in out]) if out else []
        return pa.table({"item": pa.array(item, pa.int64()), "doc": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    return run
