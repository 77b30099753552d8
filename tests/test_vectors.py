"""The nearest rows of many queries against all pairs."""

import numpy as np
import pytest

from recall_engine.operators import vectors


@pytest.mark.parametrize("block", [2, 2048])
def test_top_k_each_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "PASS_QUERIES", block)
    r = np.random.default_rng(1)
    v = np.round(r.normal(size=(300, 8)), 1)
    v[100:140] = v[0]  # many copies: ties by id
    rows = [(int(i % 3), int(i), [float(x) for x in v[i]]) for i in range(300)] + [(0, 900, None), (0, 901, [1.0]), (0, 902, [None] * 8)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>").repartition(5)
    asked = df.where("vec_id IN (0, 1, 2, 103, 7, 901) OR vec_id = 900")
    got = {}
    for x in vectors.top_k_each(df, asked, "label", 4).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, round(x.distance, 6), x.label))
    f = v.astype(np.float32).astype(float)
    for q in (0, 1, 2, 103, 7):
        own = [i for i in range(300) if i % 3 == q % 3]
        want = sorted((((f[i] - f[q]) ** 2).sum(), i) for i in own)[:4]
        assert sorted(got[q]) == [(k, i, round(d, 6), q % 3) for k, (d, i) in enumerate(want, 1)]
    assert sorted(got) == [0, 1, 2, 7, 103, 901]
    assert vectors.top_k_each(df, df.limit(0), "label", 4).count() == 0
