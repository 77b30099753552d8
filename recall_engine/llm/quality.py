"""Quality rules: document statistics and gradient-boosted trees over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.textcols import Words, binary_numbers, sequence_numbers, slices

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_upper", "n_digits", "n_stops", "n_distinct_words", "n_lines"]
#: Ratios that the trees see.  The sign says how the chance of a bad document
#: may move with the ratio: 1 never down, -1 never up, 0 either way.
FEATURES = {"word_length": 0, "symbols": 1, "dup_lines": 1, "repeat_words": 1, "upper": 0, "digits": 0, "stops": 0, "distinct_words": 0, "words_a_line": 0}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?,;:")] = True
_LEADING = (np.arange(256) & 0xC0) != 0x80


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row."""
    if not len(row):
        return np.zeros(rows, np.int64)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.bincount(r[new], minlength=rows)


def count_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for every row of a text column; null counts as empty.

    Words, lines and windows count as equal where their bytes are."""
    w = Words(column)
    rows = len(w.count)
    numbers, _ = w.known()
    out = {"n_words": w.count.astype(np.int64)}
    out["word_chars"] = _per_row(_LEADING[w.raw] & w.inside, w.offsets)
    for name, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_stops", _STOP), ("n_chars_all", _LEADING)):
        out[name] = _per_row(flags[w.raw], w.offsets)
    # lines: cut at \n and at row ends; only those with a word count
    cut = np.flatnonzero(w.raw == 10)
    begin = np.unique(np.concatenate([w.offsets[:-1][np.diff(w.offsets) > 0], cut + 1]))
    begin = begin[begin < len(w.raw)]
    end = np.empty_like(begin)
    if len(begin):
        row_of = np.searchsorted(w.offsets, begin, "right") - 1
        next_cut = np.append(cut, len(w.raw))[np.searchsorted(cut, begin)]
        end = np.minimum(next_cut, w.offsets[row_of + 1])
        has_word = np.searchsorted(w.start, begin) < np.searchsorted(w.start, end)
        row_of, begin, end = row_of[has_word], begin[has_word], end[has_word]
        out["n_lines"] = np.bincount(row_of, minlength=rows)
        out["n_dup_lines"] = out["n_lines"] - _distinct(row_of, binary_numbers(w.raw, begin, end), rows)
    else:
        out["n_lines"] = out["n_dup_lines"] = np.zeros(rows, np.int64)
    out["n_distinct_words"] = _distinct(w.row, numbers, rows)
    # words in windows of three that come twice or more in their row
    marked = np.zeros(len(numbers), bool)
    if len(numbers) >= 3:
        at = np.flatnonzero(w.row[2:] == w.row[:-2])
        value = sequence_numbers([numbers[at], numbers[at + 1], numbers[at + 2]])
        order = np.lexsort((value, w.row[at]))
        r, v = w.row[at][order], value[order]
        same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
        again = np.zeros(len(at), bool)
        again[1:] |= same
        again[:-1] |= same
        for k in range(3):
            marked[at[order[again]] + k] = True
    out["n_repeat_words"] = np.bincount(w.row[marked], minlength=rows)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def features_of(c: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, len(FEATURES)) of ratios; of a text without words all are 0."""
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "n_chars_all", "n_lines"))
    return np.stack(
        [c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_stops"] / words, c["n_distinct_words"] / words, c["n_words"] / lines],
        axis=1,
    )


@dataclass(frozen=True)
class Trees:
    """Trees as flat node arrays: inner nodes compare feature <= threshold and
    go to left or right; a leaf has feature -1 and adds its value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x, all trees and rows at once per level."""
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return self.base + self.value[node].sum(axis=1)
            go_left = x[row, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: Sequence[int], *, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 8, penalty: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss on quantile bins.

    A split on a feature with a sign is taken only if its children's values
    stand in that order, and their values bound all leaves below them.
    """
    rows, columns = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(columns)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(columns)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots, scores = [], np.full(rows, base)

    def grow(idx: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        def leaf(gs: float, hs: float) -> float:
            return float(np.clip(-gs / (hs + penalty), low, high))

        me = len(nodes)
        gs, hs = float(g[idx].sum()), float(h[idx].sum())
        nodes.append([-1, 0.0, 0, 0, leaf(gs, hs) * rate])
        best = (1e-6, -1, 0)
        if level < depth and len(idx) >= 2 * least:
            for j in range(columns):
                size = len(edges[j]) + 1
                if size < 2:
                    continue
                gl, hl, nl = (np.bincount(binned[idx, j], weights=w, minlength=size).cumsum()[:-1] for w in (g[idx], h[idx], np.ones(len(idx))))
                vl, vr = (np.clip(-a / (b + penalty), low, high) for a, b in ((gl, hl), (gs - gl, hs - hl)))
                gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                ok = (nl >= least) & (len(idx) - nl >= least)
                if monotone[j]:
                    ok &= (vr - vl) * monotone[j] >= 0
                gain = np.where(ok, gain, -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
        _, j, k = best
        if j >= 0:
            goes = binned[idx, j] <= k
            a, b = idx[goes], idx[~goes]
            bounds = [(low, high), (low, high)]
            if monotone[j]:
                middle = (leaf(float(g[a].sum()), float(h[a].sum())) + leaf(float(g[b].sum()), float(h[b].sum()))) / 2
                bounds = [(low, middle), (middle, high)] if monotone[j] > 0 else [(middle, high), (low, middle)]
            nodes[me][:2] = [j, float(edges[j][k])]
            nodes[me][2] = grow(a, level + 1, *bounds[0], g, h)
            nodes[me][3] = grow(b, level + 1, *bounds[1], g, h)
        return me

    def flat() -> Trees:
        f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
        return Trees(f.astype(np.int64), t.astype(float), left.astype(np.int64), right.astype(np.int64), v.astype(float), np.array(roots, np.int64), base)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-scores))
        first = len(nodes)
        roots.append(grow(np.arange(rows), 0, -np.inf, np.inf, p - y, p * (1 - p)))
        one = flat()
        scores += Trees(one.feature, one.threshold, one.left, one.right, one.value, np.array([first]), 0.0).score(x)
    if not rounds:
        nodes.append([-1, 0.0, 0, 0, 0.0])
    return flat()


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS...) of every whole text.  Null text counts as without
    words; null ids stay; repeated rows give repeated rows; other columns go."""

    def run(batches):
        for batch in slices(batches):
            counts = count_statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k]) for k in COUNTS)], ["doc_id", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS))


def train_quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit) -> Trees | None:
    """Trees for the chance that a document is bad (label 0).

    Fitted on at most ``sample_rows`` labelled ids, those with the smallest
    hashes: that bound is a parameter, and so is what reaches the driver.
    Of documents of equal id the one of the smallest counts is taken.  Labels
    that are null, or of no document, are left out; without any label there is
    no model (None).  Texts are counted whole, however long; other columns are
    not read.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    once = document_statistics(known).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "c.*")
    found = once.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *COUNTS, "label").toPandas()
    if found.empty:
        return None
    x = features_of({k: found[k].to_numpy() for k in COUNTS})
    return fit_trees(x, (found["label"].to_numpy() == 0).astype(float), list(FEATURES.values()), **fit)


@dataclass(frozen=True)
class Rules:
    """base_failed: fewer than ``least_words`` words, or more than
    ``most_repeat_percent`` % of them in repeated windows of three.  kept: not
    base_failed and the trees' chance of a bad document below ``bad_chance``."""

    least_words: int = 50
    most_repeat_percent: int = 50
    bad_chance: float = 0.5

    def verdict(self, column: pa.Array, model: Trees | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """(counts, base_failed, bad_score, kept) of each text; without a model
        the base decides."""
        counts = count_statistics(column)
        failed = (counts["n_words"] < self.least_words) | (100 * counts["n_repeat_words"] > self.most_repeat_percent * counts["n_words"])
        score = model.score(features_of(counts)) if model else np.zeros(len(failed)) - np.inf
        return counts, failed, score, ~failed & (score < np.log(self.bad_chance / (1 - self.bad_chance)))


def judge_quality(docs: DataFrame, model: Trees | None, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS..., base_failed, bad_score, kept): a row per document.

    Null and empty texts have no words and fail; texts are read whole, however
    long; null ids stay; repeated rows get equal rows; an empty table gives
    none; other columns, whatever they are called, go.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches):
            counts, failed, score, kept = rules.verdict(batch.column(1), model)
            columns = [batch.column(0), *(pa.array(counts[k]) for k in COUNTS), pa.array(failed), pa.array(score), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "bad_score", "kept"])

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, bad_score double, kept boolean")


def keep_good(docs: DataFrame, model: Trees | None, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of docs that judge_quality keeps, all columns as they are.

    Null and empty texts go, as they have no words; repeated rows stay or go
    alike; an empty table gives an empty one.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for part in slices([batch], batch.schema.names[place]):
                    yield part.filter(pa.array(rules.verdict(part.column(place), model)[3]))

    return docs.mapInArrow(run, docs.schema)
