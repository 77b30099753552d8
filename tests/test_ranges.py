"""Ranks, running sums and batches over keys that are cut into many parts."""

import random

import pytest
from pyspark.sql import functions as F

from recall_engine.operators import coverage, digests, ranges
from recall_engine.operators.chunking import budget_batches, greedy_batches


def folded(rows, most):
    """The batches by one pass over all rows of a key."""
    out, state = [], {}
    for key, n, c in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        size, batch = state.get(key, (0, 0))
        if size and size + (c or 0) > most:
            size, batch = 0, batch + 1
        state[key] = (size + (c or 0), batch)
        out.append((key, n, batch))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 7, 40, 3000, 10**9])
def test_batches_equal_the_fold(spark, most):
    r = random.Random(most)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), k, r.choice([0, 0, 1, 2, 5, 60, None])) for k in range(3000)] + [("zeros", k, 0) for k in range(300)] + [("last", 0, 9)]
    df = spark.createDataFrame(rows, "k string, o long, c long").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = sorted((tuple(x) for x in greedy_batches(df, most, "k", "o", "c").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == folded(rows, most)


def test_batches_of_a_million_rows_of_one_key(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(1_000_000).select(F.lit("p").alias("k"), F.col("id").alias("o"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("c"))
        parts = ranges.running(df, ["k"], ["o"], "c").groupBy("part").count().collect()
        assert len(parts) >= 4 and max(x["count"] for x in parts) < 400_000
        got = greedy_batches(df, 5000, "k", "o", "c").join(df, ["k", "o"]).orderBy("o").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    size = batch = 0
    want = []
    for c in got["c"].tolist():
        if size and size + c > 5000:
            size, batch = 0, batch + 1
        size += c
        want.append(batch)
    assert got["batch"].tolist() == want


def test_running_numbers_and_sums(spark):
    rows = [("a" if k % 5 else None, k, k % 3) for k in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, c long").repartition(5)
    got = {(x.k, x.o): (x.n, x.before) for x in ranges.running(df, ["k"], ["o"], "c").collect()}
    for key in ("a", None):
        total = 0
        for n, (_, o, c) in enumerate(r for r in rows if r[0] == key):
            assert got[key, o] == (n, total)
            total += c


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], "k string, o long, c long, batch2 string")
    assert greedy_batches(none, 5, "k", "o", "c").count() == 0
    some = spark.createDataFrame([("a", 1, 3, "x"), ("a", 2, 3, "y")], "k string, o long, c long, part string")
    assert sorted((r.o, r.part, r.batch) for r in budget_batches(some, 5, "k", "o", "c").collect()) == [(1, "x", 0), (2, "y", 1)]


def test_places_in_a_folder_of_many_names(spark):
    """Names of one folder lie in many parts, and places are gapless."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        names = spark.range(200_000).select(F.format_string("a/%s%d", F.when(F.col("id") % 2 == 0, "x").otherwise("Y"), "id").alias("path"))
        got = coverage.listed(names).where("folder = 'a'").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = got.sort_values("place")
    assert got["place"].tolist() == list(range(200_000))
    assert got["name"].tolist() == sorted(got["name"], key=lambda x: (x.lower(), x))


def test_digests_add_and_take(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("c", None)], "k string, i string")
    one = lambda df: digests.set_digest(df, ["k"], F.col("i"))
    values = lambda df: {r.k: (r.n, r.low, r.high) for r in df.collect()}
    whole = values(one(rows))
    assert whole["a"][0] == 3 and "c" not in whole and whole["a"] != values(one(rows.distinct()))["a"]
    came, went = one(rows.where("i = 'y'")), one(rows.where("i = 'z'"))
    after = digests.updated_digest(one(rows.where("coalesce(i, '') <> 'y'")), ["k"], came, went)
    assert values(after) == {"a": whole["a"]} and after.columns == ["k", "n", "low", "high"]
    assert [r.k for r in digests.changed_keys(one(rows), after, ["k"]).collect()] == ["b"]
