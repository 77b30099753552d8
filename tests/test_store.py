"""The appended index: reads as a rebuild, bytes as the changes, compaction."""

import pytest
from pyspark.sql import functions as F

from recall_engine.operators import store
from recall_engine.operators.embedding import hashed_words
from recall_engine.operators.indexing import index_rows
from recall_engine.streaming.board import follow_into_store

FILES = "project_id string, path string, language string, hash string, content string"
EMBED = hashed_words(8)


def now():
    return F.lit("2024-01-01").cast("timestamp")


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def many(n, mark=""):
    return [("p" if k % 3 else "q", f"f{k}.py", "python", f"h{k}{mark}", f"def f{k}():\n    return {k}\n\ndef g():\n    pass\n{mark}") for k in range(n)]


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(map(str, (r[c] for c in columns))) for r in df.collect()))


def test_reads_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, path)
    first = many(60)
    run = store.update_store(spark, files(spark, first), path, EMBED, now())
    assert sorted(tuple(r) for r in run.collect()) == [("p", 40, 80, 0), ("q", 20, 40, 0)]
    # two files change, one comes, two leave
    second = [*(x if k not in (4, 5) else (*x[:3], "new", "x = 1") for k, x in enumerate(first) if k not in (6, 7)), ("p", "more.py", "python", "h", "y = 2")]
    run = store.update_store(spark, files(spark, second), path, EMBED, now(), whole=True)
    assert sorted(tuple(r) for r in run.collect()) == [("p", 3, 3, 1), ("q", 0, 0, 1)]
    want = rows_of(index_rows(files(spark, second), EMBED, now()))
    assert rows_of(store.read_store(spark, path)) == want
    assert {r.project_id for r in store.read_store(spark, path, "q").collect()} == {"q"}
    assert store.update_store(spark, files(spark, second), path, EMBED, now()).count() == 0
    store.update_store(spark, files(spark, []), path, EMBED, now(), removed=spark.createDataFrame([("p", "more.py"), ("p", "never.py")], "project_id string, path string"))
    left = [x for x in second if x[1] != "more.py"]
    want = rows_of(index_rows(files(spark, left), EMBED, now()))
    assert rows_of(store.read_store(spark, path)) == want
    assert not store.compact_store(spark, path, 0.5) and store.compact_store(spark, path, 0.01)
    assert rows_of(store.read_store(spark, path)) == want and store.dead_share(spark, path) == 0
    # a file that left can come back
    store.update_store(spark, files(spark, first), path, EMBED, now(), force=True)
    assert {r.file_path for r in store.read_store(spark, path).collect()} == {x[1] for x in first}
    store.compact_store(spark, path, 0.01)
    assert store.generations(spark, path) == [1, 2]


def test_a_run_that_broke_off_is_not_read(spark, tmp_path):
    path = str(tmp_path / "s")
    store.update_store(spark, files(spark, many(3)), path, EMBED, now())
    want = rows_of(store.read_store(spark, path))
    index_rows(files(spark, many(3, "z")), EMBED, now()).withColumn("run", F.lit("lost")).write.mode("append").partitionBy("project_id", "run").parquet(f"{path}/gen-0/chunks")
    assert rows_of(store.read_store(spark, path)) == want
    store.update_store(spark, files(spark, many(4)), path, EMBED, now())
    assert len({r.file_path for r in store.read_store(spark, path).collect()}) == 4


def test_bytes_follow_the_changes(spark, tmp_path):
    """One file of many: the same bytes whatever the size of the store."""
    cost = []
    for n in (20, 400):
        path = str(tmp_path / f"s{n}")
        store.update_store(spark, files(spark, many(n)), path, EMBED, now())
        before = store.bytes_on_disk(spark, path)
        store.update_store(spark, files(spark, [("p", "f1.py", "python", "other", "x = 3")]), path, EMBED, now())
        cost.append(store.bytes_on_disk(spark, path) - before)
    assert cost[1] < 1.2 * cost[0]


def test_a_stream_into_a_store(spark, tmp_path):
    path, at = str(tmp_path / "s"), str(tmp_path / "in")
    shape = f"{FILES}, deleted boolean, mtime long"

    def put(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(at)
        q = follow_into_store(spark.readStream.schema(shape).parquet(at), path, EMBED, str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(100)
        return sorted((r.file_path, r.content) for r in store.read_store(spark, path).collect())

    assert put([("p", "a.py", "python", "1", "x = 1", None, 1), ("p", "a.py", "python", "2", "x = 2", False, 2), ("p", "b.py", "python", "1", "y", None, 1)]) == [("a.py", "x = 2"), ("b.py", "y")]
    assert put([("p", "a.py", "python", "3", None, True, 3), ("p", "c.py", "python", "1", "z", None, 3)]) == [("b.py", "y"), ("c.py", "z")]
