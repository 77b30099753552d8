"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.llm.components import components
from recall_engine.llm.stage import NULL_ID, discard, keyed, public_id, row_key, written
from recall_engine.llm.textcols import Words, chained, give_back, mix, slices

#: ASCII letters to lower case, and the separators of words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TO_SPACE = bytes(32 if b in (0x20, *range(0x09, 0x0E)) else b for b in range(256))


@dataclass(frozen=True)
class MinHash:
    """words a shingle; least similarity in percent; bands of rows coordinates.

    A pair at 80 % misses all 48 bands of 6 with a chance of 5e-7.
    sketch: coordinates kept as bytes to drop pairs that only met by chance:
    at 80 % fewer than sketch_least of 288 agree with a chance of 1e-8.
    """

    words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    sketch: int = 288
    sketch_least: int = 190
    seed: int = 11
    #: Members of a bucket that one comparison of blocks takes from each side.
    block: int = 2048
    #: Least hashes of a set kept for comparing blocks: smaller sets are whole.
    #: Of sets cut to 1024, a pair at 80 % shows under 72 % with a chance of 1e-9.
    low: int = 1024
    low_percent: int = 72


def shingle_hashes(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, others, ends): the distinct shingles of every row as two 64-bit
    hashes, which come from the two halves of the words' 128-bit ones, sorted by
    the first.

    A text of fewer words has its whole sequence as its one shingle; one
    without words has none."""
    w = Words(column, lower=True)
    halves = w.hashes()
    rows = len(w.count)
    n = len(w.row)
    at = np.flatnonzero(w.row[words - 1 :] == w.row[: n - words + 1]) if n >= words else np.zeros(0, np.int64)
    owners = [w.row[at]]
    found = [[chained([half[at + k] for k in range(words)])] for half in halves.T]
    for size in range(1, words):
        few = np.flatnonzero(w.count == size)
        owners.append(few)
        for half, parts in zip(halves.T, found, strict=True):
            parts.append(mix(chained([half[w.first[few] + k] for k in range(size)]) + np.uint64(size)))
    row = np.concatenate(owners)
    value, other = (np.concatenate(parts) for parts in found)
    order = np.lexsort((value, row))
    value, other, row = value[order], other[order], row[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (other[1:] != other[:-1]) | (row[1:] != row[:-1])
        value, other, row = value[new], other[new], row[new]
    return value, other, np.searchsorted(row, np.arange(rows + 1))


def circulant_signatures(values: np.ndarray, ends: np.ndarray, size: int, seed: int) -> np.ndarray:
    """(rows, size) of uint32: coordinate k is the minimum of pi(sigma(x) + k).

    sigma maps shingles to places of a circle of 2**32, pi permutes the circle;
    shifting the places by one gives the next coordinate.  Rows without values
    hold the largest number."""
    rows = len(ends) - 1
    out = np.full((size, rows), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(ends) > 0)
    rng = np.random.default_rng(seed)
    odd = (rng.integers(1, 1 << 31, 3, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    at = 0
    while at < len(filled):  # runs of rows that fit the processor's cache
        to = max(at + 1, int(np.searchsorted(ends[filled + 1], ends[filled[at]] + 65_536, "right")))
        span = filled[at:to]
        first = ends[span[0]]
        place = (mix(values[first : ends[span[-1] + 1]] ^ np.uint64(seed * 0x9E3779B1)) >> np.uint64(32)).astype(np.uint32)
        cut = ends[span] - first
        v, t = np.empty_like(place), np.empty_like(place)
        for k in range(size):
            np.add(place, np.uint32(k), out=v)
            np.multiply(v, odd[0], out=v)
            np.right_shift(v, 15, out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, odd[1], out=v)
            np.right_shift(v, 13, out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, odd[2], out=v)
            out[k, span] = np.minimum.reduceat(v, cut)
        at = to
    return out.T


def _signed(docs: DataFrame, how: MinHash) -> DataFrame:
    """(key, id, n, s1, s2, bands, sketch) for every document; s1 and s2 are the
    xxh3-128 of the whole set, as 128-bit hashes of its shingles."""

    def run(batches):
        for batch in slices(batches):
            values, others, ends = shingle_hashes(batch.column(2), how.words)
            signature = circulant_signatures(values, ends, how.bands * how.rows, how.seed)
            raw = np.stack([values, others], axis=1).tobytes()
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[16 * a : 16 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]), np.int64).reshape(-1, 2)
            wide = signature.astype(np.uint64).reshape(len(signature), how.bands, how.rows)
            band = (chained([wide[:, :, k] for k in range(how.rows)]) + mix(np.arange(1, how.bands + 1, dtype=np.uint64))).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(band) + 1, dtype=np.int32) * how.bands), pa.array(band.ravel()))
            sketch = [x.tobytes() for x in (signature[:, : how.sketch] & 0xFF).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists, pa.array(sketch, pa.binary())], ["key", "id", "n", "s1", "s2", "bands", "sketch"])

    return docs.mapInArrow(run, "key long, id long, n long, s1 long, s2 long, bands array<long>, sketch binary")


def word_shingles(text: str, words: int) -> set[tuple[bytes, ...]]:
    """The true set, for exact checks."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_TO_SPACE).split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(words)), strict=False))


@lru_cache(maxsize=8)
def _set_of(text: str, words: int) -> set:
    return word_shingles(text, words)


def _low_hashes(texts: DataFrame, how: MinHash) -> DataFrame:
    """(cid, low): the least 32-bit shingle hashes of each text, sorted."""

    def run(batches):
        for batch in slices(batches):
            values, _, ends = shingle_hashes(batch.column(1), how.words)
            short = (mix(values) >> np.uint64(32)).astype(np.uint32)
            lows = [np.sort(short[a:b])[: how.low].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lows, pa.binary())], ["cid", "low"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, low binary")


def similar_by_low(x: np.ndarray, nx: int, ys: list[np.ndarray], ny: np.ndarray, how: MinHash) -> np.ndarray:
    """Which sets y may be similar enough to x, by their least hashes.

    Sets of up to ``how.low`` shingles are compared whole, with room for two
    hashes that collide; of larger ones the least hashes of the union are a
    sample."""
    keep = np.zeros(len(ys), bool)
    whole = np.flatnonzero((ny <= how.low) & (nx <= how.low))
    if len(whole):
        parts = [ys[i] for i in whole]
        joined = np.concatenate(parts)
        place = np.minimum(np.searchsorted(x, joined), len(x) - 1)
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        both = np.add.reduceat((x[place] == joined).astype(np.int64), first)
        keep[whole] = 100 * (both + 2) >= how.percent * (nx + ny[whole] - both - 2)
    for i in np.flatnonzero((ny > how.low) | (nx > how.low)):
        value, times = np.unique(np.concatenate([x, ys[i]]), return_counts=True)
        keep[i] = 100 * int((times[: how.low] > 1).sum()) >= how.low_percent * min(how.low, len(value))
    return keep


def _likely_with_leader(placed: DataFrame, leader: DataFrame, chosen: DataFrame, how: MinHash) -> DataFrame:
    """(a, b): each bucket's leader and members of other labels whose sizes and
    sketches allow the similarity."""
    pairs = placed.join(leader, "bucket").where(F.col("label") != F.col("leader_label")).select("a", F.col("cid").alias("b")).distinct()
    side = lambda c: chosen.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, how.sketch) for i in (2, 3))
            keep = np.flatnonzero((x == y).sum(axis=1) >= how.sketch_least)
            yield batch.take(pa.array(keep)).select(["a", "b"])

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.col("na") >= how.percent * F.col("nb")) & (100 * F.col("nb") >= how.percent * F.col("na")))
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _likely_in_blocks(open_rows: DataFrame, chosen: DataFrame, texts: DataFrame, how: MinHash) -> DataFrame:
    """(a, b): pairs of different labels within a bucket whose sizes, sketches
    and least hashes allow the similarity.

    Rows (bucket, band, size, cid, label).  A bucket is cut into blocks, and
    tasks compare two blocks at a time.  A pair is looked at in the first band
    that it shares, and only likely pairs leave a task.
    """
    blocks = F.ceil(F.col("size") / how.block).cast("int")
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    lows = _low_hashes(texts.join(open_rows.select("cid").distinct(), "cid", "left_semi"), how)
    rows = (
        open_rows.join(chosen.select("cid", "n", "sketch").join(lows, "cid"), "cid")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cid", "label", "n", "band", "sketch", "low")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
    )

    def pairs_of(table: pa.RecordBatch):
        bucket, i, j, mine, cid, label, n, band = (np.asarray(table.column(k)) for k in range(8))
        sketch = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint8).reshape(-1, how.sketch)
        low = [np.frombuffer(x, np.uint32) for x in table.column(9).to_pylist()]
        new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found_a, found_b = [], []
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(bucket)], strict=True):
            left = right = np.arange(a, b)
            if i[a] != j[a]:
                left, right = left[mine[a:b] == i[a]], left[mine[a:b] == j[a]]
            for x in left:
                ys = right[right > x] if i[a] == j[a] else right
                ys = ys[(label[ys] != label[x]) & (100 * n[ys] >= how.percent * n[x]) & (100 * n[x] >= how.percent * n[ys])]
                if not len(ys):
                    continue
                same = sketch[ys] == sketch[x]
                ok = same.sum(axis=1) >= how.sketch_least
                # equal bytes of a band's rows are an equal band but for 2**-48
                ok[ok] = same[ok].reshape(-1, how.bands, how.rows).all(axis=2).argmax(axis=1) == band[x]
                ys = ys[ok]
                if len(ys):
                    ys = ys[similar_by_low(low[x], int(n[x]), [low[y] for y in ys], n[ys], how)]
                    found_a.append(np.full(len(ys), cid[x]))
                    found_b.append(cid[ys])
        a, b = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (found_a, found_b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = [np.asarray(batch.column(k)) for k in range(3)]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)) if batch.num_rows else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield pairs_of(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None and held.num_rows:
            yield pairs_of(held)
        batch = keys = held = None
        give_back()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _confirmed(likely: DataFrame, texts: DataFrame, how: MinHash) -> DataFrame:
    """The pairs (a, b) of class ids whose whole sets are similar enough."""
    text = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias(f"t{c}"))

    def exact(batches):
        for batch in slices(batches, "tb"):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                s, t = _set_of(x, how.words), word_shingles(y, how.words)
                both = len(s & t)
                if 100 * both >= how.percent * (len(s) + len(t) - both):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    full = likely.join(text("b"), "b").join(text("a"), "a").select("a", "b", "ta", "tb")
    return full.mapInArrow(exact, "a long, b long")


def near_duplicates(docs: DataFrame, how: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text", most_rounds: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents of equal shingle sets form a class; only one of each goes on.
    Classes that share a band are candidates.  In rounds, each bucket compares
    its members with one leader (another one each round) unless both are known
    to be connected; confirmed links join components.  Once the pairs that
    remain unconnected within buckets are few, all of them are compared.  Which
    links are then not looked at are those within components, so components are
    those of all links, without comparing all pairs of a large group.

    Null and empty texts have no shingles, link with nothing and are kept; long
    ones are read whole.  Classes are told apart by the 128-bit digest of their
    whole sets and numbered one by one.  A null id orders before all others and
    comes back as null.  Rows of equal id and text have equal results; other
    columns go; an empty table gives none.
    """
    component = F.coalesce("component", "id")
    return _resolved(keyed(docs, id_col, text_col), how, most_rounds).select(public_id().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component != F.lit(NULL_ID), component).alias("component_id"), (F.col("id") == component).alias("kept"))


def keep_one_each(docs: DataFrame, how: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text", most_rounds: int = 4) -> DataFrame:
    """docs less near-duplicates: of each component the row of the smallest id stays.

    Where several texts of a component bear that id, the one of the smallest
    hash stays; repeated rows count once.  Documents without shingles (null or
    empty texts) stay.  Texts are read whole; all columns stay as they are,
    whatever they are called; an empty table gives an empty one.
    """
    found = _resolved(keyed(docs, id_col, text_col), how, most_rounds)
    alone = found.where(F.col("n") == 0).select("key", "id").distinct()
    best = found.where(F.col("n") > 0).groupBy("group").agg(F.min(F.struct("id", "key")).alias("x")).select("x.key", "x.id")
    # all columns travel as one, so that none can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"))
    return rows.join(alone.unionByName(best), ["key", "id"], "left_semi").dropDuplicates(["key", "id"]).select("row.*")


def _resolved(rows: DataFrame, how: MinHash, most_rounds: int) -> DataFrame:
    """(key, id, n, group, component) for rows of ``keyed``: group numbers the
    component, component is its smallest id; both null without shingles."""
    signed = written(_signed(rows, how), "signatures")
    # one row a class; its number is a place in the table, so no two share one
    one = signed.where(F.col("n") > 0).groupBy("s1", "s2").agg(F.min("id").alias("first_id"), F.first(F.struct("key", "n", "bands", "sketch")).alias("x"))
    members = written(one.select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "first_id", "x.*"), "members")
    each = members.select("cid", F.posexplode("bands").alias("band", "bucket"))
    often = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    shared = written(each.join(often, "bucket"), "shared-buckets")
    buckets = written(shared.join(shared.groupBy("cid").agg(F.sum("size").alias("met")), "cid"), "buckets")
    discard(shared)
    chosen = written(members.join(buckets.select("cid").distinct(), "cid").select("cid", "key", "n", "sketch"), "classes")
    texts = written(rows.join(chosen.select("cid", "key"), "key").select("cid", "text").dropDuplicates(["cid"]), "class-texts")

    links, label, before = None, None, None
    for turn in range(most_rounds + 1):
        placed = buckets.withColumn("label", F.col("cid")) if label is None else buckets.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        placed = written(placed, "placed")
        # pairs that stay open: all in a bucket less those within components
        by_label = placed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
        open_pairs = by_label.groupBy("bucket").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("open"), F.count(F.lit(1)).alias("labels")).where(F.col("labels") > 1)
        left = open_pairs.agg(F.coalesce(F.sum("open"), F.lit(0)).alias("n")).first()["n"]
        last = turn == most_rounds or (before is not None and left > 0.75 * before)
        before = left
        if left and last:
            likely = _likely_in_blocks(placed.join(open_pairs.select("bucket"), "bucket"), chosen, texts, how)
        elif left:
            # first the member that meets most others: a copied text meets its
            # copies more often than they meet each other; then any other one
            rank = F.xxhash64("cid", F.lit(turn)) if turn else -F.col("met")
            leader = placed.groupBy("bucket").agg(F.min(F.struct(rank.alias("r"), F.col("cid").alias("a"), F.col("label").alias("leader_label"))).alias("x")).select("bucket", "x.a", "x.leader_label")
            likely = _likely_with_leader(placed, leader, chosen, how)
        else:
            discard(placed)
            break
        more = written(_confirmed(likely, texts, how), "links")
        discard(placed)
        links = more if links is None else links.unionByName(more)
        label = components(links).select(F.col("node").alias("cid"), "label")
        if last:
            break
    if label is None:
        label = buckets.select("cid", F.col("cid").alias("label")).limit(0)

    owner = members.select("cid", "s1", "s2", "first_id")
    merged = label.join(owner, "cid").groupBy("label").agg(F.min("first_id").alias("component"))
    of_class = owner.join(label.join(merged, "label"), "cid", "left").select("s1", "s2", F.coalesce("label", "cid").alias("group"), F.coalesce("component", "first_id").alias("component"))
    shown = [F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("s1", "s2")]
    return signed.select("key", "id", "n", *shown).join(of_class, ["s1", "s2"], "left").select("key", "id", "n", "group", "component")
