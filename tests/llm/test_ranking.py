"""Ranked search against brute force: all rows, awkward texts, ties and shards."""

import collections
import math
import random
import re

import numpy as np
import pytest

from recall_engine.llm import ranking
from recall_engine.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, items, k=10):
    """documents: (id, text); items: (id, text)."""
    counted = [(i, collections.Counter(terms(t))) for i, t in documents]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(r.choices(words, weights, k=r.choice([3, 20, 200])))) for i in range(n)]
    return rows + [
        (n, None), (n + 1, ""), (n + 2, "!? -- \x7f"), (n + 3, rows[0][1]), (n + 3, rows[0][1]), (None, rows[1][1]), (-5, rows[1][1]),
        (n + 4, "Café CAFÉ café w1\x1fw2 ÀB 中文 w3"), (n + 5, " ".join(f"long{i % 977} w5" for i in range(400_000))), (n + 6, "x" * 3_000_000 + " w7"),
    ]


ITEMS = [(0, "w0 w1 W1 w17 w390"), (1, "w5, w5; café"), (2, None), (3, ""), (4, "unknown words"), (5, "w300"), (None, "w7 w8 w9"), (6, " ".join(f"w{i}" for i in range(0, 400, 3))), (5, "w17 long5")]
DOCS = "doc_id long, text string, score string, shard string, item string"


@pytest.mark.parametrize("shard_bytes", [20_000, 16 << 20])
def test_search_equals_brute_force(spark, shard_bytes):
    rows = corpus(900, 3)
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS).repartition(3)
    items = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id long, text string, rank int")
    index = ranking.build_index(docs, shard_bytes=shard_bytes)
    assert (index.where("term = ''").count() > 8) == (shard_bytes == 20_000)
    got = ranking.search(index, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, ITEMS)


def test_search_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", 1)
    monkeypatch.setattr(ranking, "PASS_BLOCKS", 2)
    rows = corpus(60, 5)
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in ranking.search(ranking.build_index(docs), items, 3).collect()), key=str) == brute(rows, ITEMS, 3)


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.search(ranking.build_index(none), items).count() == 0
    some = spark.createDataFrame(corpus(5, 1), "doc_id long, text string")
    assert ranking.search(ranking.build_index(some), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_block_maxima_spare_decompression():
    """A rare term settles the threshold: most blocks of a common one stay closed."""
    docs = 50_000
    r = np.random.default_rng(1)
    lengths = r.integers(50, 500, docs)
    rare = np.sort(r.choice(docs, 200, replace=False))
    at = np.array([0, docs, docs + len(rare)])
    doc = np.concatenate([np.arange(docs), rare])
    tf = np.concatenate([r.integers(1, 4, docs), r.integers(1, 9, len(rare))])
    scoring = ranking.Scoring()
    impact = lambda t, n: scoring.impact(t, n, docs, int(lengths.sum()))
    packed = ranking._compressed(at, doc, tf, lengths[doc])
    common, scarce = (ranking._List(int(at[i + 1] - at[i]), *(x[i].as_py() for x in packed), lengths, impact) for i in range(2))
    lists = [(common, 1), (scarce, 6000)]
    best, scores = ranking.best_of_shard(lists, docs, 10)
    whole = np.zeros(docs, np.int64)
    whole[:] += impact(tf[:docs], lengths)
    whole[rare] += 6000 * impact(tf[docs:], lengths[rare])
    order = np.lexsort([np.arange(docs), -whole])[:10]
    assert best.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    assert common.known.mean() < 0.5


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_ranked_search"](spark, sf).collect()), key=str)
    assert got == brute(docs, items)
