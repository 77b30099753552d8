"""Removal of byte strings that occur elsewhere, by deep-shallow suffix sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.repeats import Group, Read, Units, contexts, gathered, repeated_windows, with_spans
from recall_engine.llm.stage import NULL_ID, keyed, public_id, row_key, written
from recall_engine.llm.textcols import buffer_of, byte_values, prefix_hash, slices

#: Bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 32


def _read(column: pa.Array) -> Read:
    raw, offsets = buffer_of(column)
    whole = raw.tobytes()
    return Read(prefix_hash(byte_values(raw)), offsets, lambda a, b: whole[a:b])


def _regroup(group: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group, alone): suffixes of groups of two or more, split by the
    keys, and those left alone; groups keep their order and are numbered anew."""
    order = np.lexsort((*keys[::-1], group))
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in (group, *keys):
        new[1:] |= k[order][1:] != k[order][:-1]
    number = np.cumsum(new) - 1
    alone = np.bincount(number)[number] == 1
    return order[~alone], number[~alone], order[alone]


def equal_windows(text: np.ndarray, start: np.ndarray, group: np.ndarray, length: int, copies: np.ndarray | None = None) -> np.ndarray:
    """Flags the suffixes whose first ``length`` bytes come twice in their group.

    A suffix stands for ``copies`` (one, if not given) of itself.  Deep-shallow
    sorting of all groups at once.  Shallow: multikey quicksort whose characters
    are eight bytes (big-endian, so the order is that of the bytes); suffixes
    alone in their part drop out.  Deep: a part that shares SHALLOW bytes
    becomes a blind trie.  It keeps only where its suffixes leave the path of
    its first one and by which character; those that leave at one place by one
    character form the subtree below, and those that never leave are equal.
    """
    flags = np.zeros(len(start), bool)
    copied = np.zeros(len(start), bool) if copies is None else copies > 1
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.ndarray(len(text) + 1, "<u8", padded.data, strides=(1,))
    at = np.arange(len(start))

    def split(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        nonlocal at
        order, group, alone = _regroup(group, *keys)
        flags[at[alone]] = copied[at[alone]]
        at = at[order]
        return group

    group = split(group)
    shallow = min(SHALLOW, length // 8 * 8)
    for depth in range(0, shallow, 8):
        if not len(at):
            return flags
        group = split(group, word[start[at] + depth].byteswap())
    # places of the remaining characters; the last one may overlap
    places = np.unique(np.minimum(np.arange(shallow, max(length, shallow + 1), 8), max(length - 8, 0)))
    while len(at):
        first = np.searchsorted(group, group)
        leaves = np.full(len(at), len(places), np.int64)
        for a in range(0, len(at), 32_768):
            part = slice(a, a + 32_768)
            differ = word[start[at[part]][:, None] + places] != word[start[at[first[part]]][:, None] + places]
            leaves[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), len(places))
        equal = leaves == len(places)
        flags[at[equal]] = (np.bincount(group, weights=equal)[group] > 1)[equal] | copied[at[equal]]
        at, group, leaves = at[~equal], group[~equal], leaves[~equal]
        if len(at):
            group = split(group, leaves, word[start[at] + places[leaves]].byteswap())
    return flags


def _compare(length: int):
    def compare(g: Group) -> np.ndarray:
        base = np.repeat(g.offset[:-1], g.windows)
        within = np.arange(len(base)) - np.repeat(np.cumsum(g.windows) - g.windows, g.windows)
        # windows of one anchor can only be equal at the same distance from it
        anchor = np.cumsum(np.concatenate([[0], (g.h[1:] != g.h[:-1]).astype(np.int64)]))
        distance = np.repeat(g.at, g.windows) - within
        return equal_windows(g.text, base + within, np.repeat(anchor, g.windows) * (length + 1) + distance, length, np.repeat(g.copies, g.windows))

    return compare


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, text, spans) for every row: the byte stretches covered by a
    ``length``-byte string that also starts anywhere else.

    Strings are UTF-8 bytes, never cross documents and are judged on the input;
    the other start may be in the same document and may overlap.  Null text
    counts as empty, texts shorter than ``length`` have no spans, long ones are
    read whole, repeated rows are repeats of each other, null ids are ids of
    their own, an empty table gives no rows, other columns go.
    """
    rows = keyed(docs, id_col, text_col)
    return with_spans(rows, _repeats(rows, length))


def _repeats(rows: DataFrame, length: int) -> DataFrame:
    """(key, id, start, end) in bytes for rows of ``keyed``."""
    units = Units(length, max(1, min(32, length // 2)), _read)
    return repeated_windows(written(contexts(rows, units), "contexts"), rows, units, _compare(length), later_only=False)


def cut_bytes(marked: DataFrame) -> DataFrame:
    """(doc_id, key, kept binary, n_bytes, n_removed, n_spans): what is left of
    each row of suffix_dedup, as bytes, whatever the length of its text."""

    def run(batches):
        for batch in slices(batches):
            raw, offsets = buffer_of(batch.column(2))
            raw = raw.tobytes()
            kept, size, gone, count = [], [], [], []
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(3).to_pylist(), strict=True):
                at, out = a, []
                for s in spans or ():
                    out.append(raw[at : a + s["start"]])
                    at = a + s["end"]
                out.append(raw[at:b])
                kept.append(b"".join(out))
                size.append(b - a)
                gone.append(b - a - len(kept[-1]))
                count.append(len(spans or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, gone, count))], ["key", "doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return marked.select("key", "id", "text", "spans").mapInArrow(run, "key long, doc_id long, kept binary, n_bytes long, n_removed long, n_spans long").withColumn("doc_id", public_id("doc_id"))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans of suffix_dedup cut out of the text.

    A cut may fall within a character; what is left of it goes.  All rows and
    columns stay, whatever the columns are called; texts without spans, null
    and empty ones included, stay as they are; long ones are read whole;
    repeated rows lose their spans alike; an empty table gives an empty one.
    """
    names = docs.columns
    place = names.index(text_col)
    spans = gathered(_repeats(keyed(docs, id_col, text_col), length))
    # all columns travel as one, so that none can clash
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"))
    marked = whole.join(spans, ["key", "id"], "left").select("row.*", "spans").toDF(*(f"c{i}" for i in range(len(names))), "spans")

    def run(batches):
        for batch in slices(batches, f"c{place}"):
            out = []
            for text, cuts in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if cuts:
                    raw = text.encode()
                    at = [0, *(c["end"] for c in cuts)]
                    text = b"".join([raw[a:b] for a, b in zip(at, [*(c["start"] for c in cuts), len(raw)], strict=True)]).decode("utf-8", "ignore")
                out.append(text)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.mapInArrow(run, docs.schema)
