"""Packing of token pieces into training sequences by vector best fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.llm.stage import written
from recall_engine.llm.textcols import give_back, slices
from recall_engine.llm.tokenize import id_lists, unit_encoder


@dataclass(frozen=True)
class Capacity:
    """What one sequence can hold, and how residuals are weighed.

    tokens; documents (pieces); attention: the cost of attention that is masked
    to documents and computed in tiles, the square of ceil(length / tile) summed
    over the pieces.  Where documents and attention are not given they follow
    from the pieces that are packed together: what an even share of the least
    number of sequences holds, half as much again, and room for the costliest
    piece.  So they deal pieces evenly over the sequences but don't call for
    more of them; where they do, by more than one, tokens alone bind.

    measure: 'norm' takes the bin that leaves the least weighted residual norm,
    'dot' the one whose residual has the largest weighted dot product with the
    piece.  Residuals count as shares of the capacities.
    """

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    tile: int = 64
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    measure: str = "norm"
    #: Pieces that one task's round works on: bounds memory; each round leaves
    #: at most a few bins part empty.
    round_pieces: int = 16_384

    def needs(self, lengths: np.ndarray) -> np.ndarray:
        """(3, pieces): tokens, documents and attention of each piece."""
        tiles = np.ceil(lengths / self.tile)
        return np.stack([lengths.astype(float), np.ones(len(lengths)), tiles * tiles])


def cut_pieces(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    *,
    tokens: int = 1024,
    keeps_space: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    measures: dict[str, Callable[[np.ndarray], int]] | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids): each whole text's ids and ``end_id``.

    ``measures`` adds a long column for each function of a piece's uint32 ids,
    computed where the piece is made; without ``with_ids`` the ids stay there.

    Only documents of more than ``tokens`` ids are cut: into full pieces, the
    first one shorter where the count is no multiple.  Null text counts as
    empty (its one piece holds the end id), texts are encoded whole however
    long, null ids stay null, repeated rows give repeated pieces, an empty table
    none; other columns go.
    """
    measures = measures or {}
    schema = "doc_id long, piece int, start long, length long" + (", ids array<int>" if with_ids else "") + "".join(f", `{name}` long" for name in measures)

    def run(batches):
        encoder = unit_encoder(vocabulary, keeps_space)
        end = np.array([end_id], np.uint32)
        for batch in slices(batches):
            arrays = encoder.encode([x or "" for x in batch.column(1).to_pylist()])
            owner, piece, start, parts = [], [], [], []
            for row, ids in enumerate(arrays):
                ids = np.concatenate([ids, end])
                at, k = 0, 0
                while at < len(ids):
                    to = at + ((len(ids) - at) % tokens or tokens)
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    parts.append(ids[at:to])
                    at, k = to, k + 1
            columns = {
                "doc_id": batch.column(0).take(pa.array(owner, pa.int64())),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array([len(x) for x in parts], pa.int64()),
            }
            if with_ids:
                columns["ids"] = id_lists(parts)
            for name, measure in measures.items():
                columns[name] = pa.array([measure(x) for x in parts], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: longest first, each into the open bin that
    fits best by the capacity's measure under every constraint, ties to the bin
    opened first or moved up; a new bin where none fits."""
    least = -(-int(lengths.sum()) // capacity.tokens)
    found = _best_fit(lengths, capacity, _capacities(lengths, capacity, least))
    if len(lengths) and found[0].max() > least and (capacity.documents is None or capacity.attention is None):
        loose = _best_fit(lengths, capacity, _capacities(lengths, capacity, 0))
        found = min(found, loose, key=lambda x: x[0].max())
    return found


def _capacities(lengths: np.ndarray, capacity: Capacity, least: int) -> np.ndarray:
    """Tokens, documents and attention of a sequence, those not given by even
    shares of ``least`` sequences, without bound where that is 0."""
    needs = capacity.needs(lengths)
    shares = [needs[k].max() + np.ceil(1.5 * needs[k].sum() / least) if least else max(needs[k].sum(), 1.0) for k in (1, 2)] if len(lengths) else [1.0, 1.0]
    return np.array([capacity.tokens, *(share if given is None else given for share, given in zip(shares, (capacity.documents, capacity.attention), strict=True))], float)


def _best_fit(lengths: np.ndarray, capacity: Capacity, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.array(capacity.weights) / full**2
    order = np.argsort(-lengths, kind="stable")
    n = len(lengths)
    needs = capacity.needs(lengths)
    if n and (needs > full[:, None]).any():
        raise ValueError(f"a piece of {int(lengths.max())} tokens exceeds a capacity")
    least = needs.min(axis=1) if n else full
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.zeros((3, 1024))
    name = np.zeros(1024, np.int64)
    open_bins, made = 0, 0
    for i in order:
        need = needs[:, i]
        at = -1
        if open_bins:
            rest = left[:, :open_bins] - need[:, None]
            fits = (rest >= 0).all(axis=0)
            if fits.any():
                if capacity.measure == "dot":
                    at = int(np.argmax(np.where(fits, (scale * need) @ left[:, :open_bins], -np.inf)))
                else:
                    at = int(np.argmin(np.where(fits, scale @ (rest * rest), np.inf)))
        if at < 0:
            if open_bins == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
                name = np.concatenate([name, np.zeros_like(name)])
            at = open_bins
            left[:, at], name[at] = full, made
            open_bins, made = open_bins + 1, made + 1
        bins[i], offsets[i] = name[at], full[0] - left[0, at]
        left[:, at] -= need
        if (left[:, at] < least).any():
            open_bins -= 1
            left[:, at], name[at] = left[:, open_bins], name[open_bins]
    return bins, offsets


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), length_col: str = "length") -> DataFrame:
    """Adds sequence_id (long) and offset (long) to pieces of at most capacity.tokens.

    Full pieces are sequences of their own.  The others are spread evenly over
    tasks, whatever their documents, and each task packs rounds of
    ``capacity.round_pieces`` by best fit.  The pieces are written before, so a
    task that runs again sees the same rows.  Columns of the two names are
    replaced, other columns stay; repeated rows are packed each, rows of null
    length are left out; an empty table gives no rows.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = written(pieces.select(*keep), "pieces")
    place = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        base = (TaskContext.get().partitionId() + 1) << 36
        held, n = [], 0

        def place_all():
            nonlocal base
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins, offsets = best_fit(np.asarray(table.column(table.schema.get_field_index(length_col))), capacity)
            out = pa.RecordBatch.from_arrays([*(table.column(i) for i in range(table.num_columns)), pa.array(bins + base), pa.array(offsets)], [*table.schema.names, "sequence_id", "offset"])
            base += int(bins.max()) + 1
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, capacity.round_pieces):
                part = batch.slice(at, capacity.round_pieces)
                held.append(part)
                n += part.num_rows
                if n >= capacity.round_pieces:
                    yield place_all()
                    held, n = [], 0
        if n:
            yield place_all()
        batch = part = held = None
        give_back()

    full = rows.where(F.col(length_col) == capacity.tokens).withColumns({"sequence_id": F.monotonically_increasing_id() - F.lit(2**62), "offset": F.lit(0).cast("long")})
    rest = rows.where(F.col(length_col) != capacity.tokens)
    tasks = max(1, -(-rest.count() // capacity.round_pieces))
    # dealt by the row's place in the table, so that repeated rows go to many tasks
    number = "_row"
    while number in keep:
        number += "_"
    dealt = rest.withColumn(number, F.monotonically_increasing_id()).repartition(tasks, number).select(*(F.col(f"`{c}`") for c in keep))
    return full.unionByName(dealt.mapInArrow(run, place))
