"""Importance resampling against brute force: gains, weights, exact ranks."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from recall_engine.llm import resampling
from recall_engine.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest, buckets):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(documents, target, percent=10, least=20, longest=1, buckets=10_000, seed="2024"):
    of = [(i, *features(t, longest, buckets)) for i, t in documents]
    s = collections.Counter(b for _, _, f in of for b in f)
    t = collections.Counter(b for x in target for b in features(x, longest, buckets)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, n, f in of:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    open_ = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(open_[: percent * len(open_) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=str)


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "中文", "x9"]
    rows = [(i, r.choice([" ", "\n", "--"]).join(r.choices(words, k=r.choice([0, 5, 19, 20, 60])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\x7f !"), (5, rows[7][1]), (n + 3, rows[7][1]), (n + 3, rows[7][1]), (None, rows[9][1]), (n + 4, " ".join(f"long{i % 977} W5" for i in range(300_000)))]


TARGET = ["w1 w2 w3 W1 été", None, "", "w1 w1 long5 unseen"]


def sampled(spark, rows, target, **options):
    docs = spark.createDataFrame([(*r, 0, "a") for r in rows], "doc_id long, text string, score int, segment string").repartition(5)
    aims = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = resampling.resample(docs, aims, **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"percent": 100, "least_words": 0}, {"percent": 37, "buckets": 7, "seed": "x"}, {"percent": 0}, {"longest": 3, "buckets": 500, "percent": 50}])
def test_resample_equals_brute_force(spark, options):
    rows = corpus(400, 2)
    names = {"least_words": "least"}
    assert sampled(spark, rows, TARGET, **options) == brute(rows, TARGET, **{names.get(k, k): v for k, v in options.items()})


def test_ranks_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SAMPLES", 64)
    monkeypatch.setattr(resampling, "MOST_SEGMENTS", 16)
    r = random.Random(4)
    rows = [(i % 900, r.choice([7, 7, r.randrange(50)])) for i in range(5000)]
    docs = spark.createDataFrame(rows, "id long, score long").repartition(7)
    got = resampling.rank_highest(docs, "id % 3 > 0", 80).collect()
    want = sorted((-s, i) for i, s in rows if i % 3)
    assert sorted((x.rank, -x.score, x.id) for x in got if x.rank) == [(k, *x) for k, x in enumerate(want[: 80 * len(want) // 100], 1)]
    assert sorted((x.id, x.score) for x in got) == sorted(rows)


def test_empty_tables(spark):
    assert sampled(spark, [], TARGET) == []
    rows = corpus(30, 1)
    assert sampled(spark, rows, [], percent=50) == brute(rows, [], 50)


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_importance_resampling"](spark, sf).collect()), key=str)
    assert got == sorted(((i, f, w, s, k) for i, _, f, w, s, k in brute(docs, target)), key=str)
