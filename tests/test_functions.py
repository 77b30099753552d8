import pytest
from pyspark.sql import functions as F

from recall_engine.functions import text as T
from recall_engine.operators.chunking import greedy_batches, pack_lines
from recall_engine.sources.files import changed, scan_files
from recall_engine.streaming.events import session_counts


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [
        ("Create UserDTO for authentication", "Create UserDTO for authentication", 1, 1),
        ("Create UserDTO for authentication", "Create UserDTO for authentification", 0.85, 1),
        ("Create UserDTO for authentication", "Implement payment gateway service", 0, 0.5),
        ("CREATE USERDTO", "create userdto", 1, 1),
        ("  Create   UserDTO   ", "Create UserDTO", 1, 1),
        ("", "", 1, 1),
        ("", "test", 0, 0),
    ],
)
def test_similarity(spark, a, b, low, high):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.text_similarity(F.col("a"), F.col("b"))).first()[0]
    assert low <= got <= high


def test_paths(spark):
    row = spark.createDataFrame([("src/Auth.TS", "/x/My  Project!")], "p string, n string").select(T.language(F.col("p")), T.extension(F.col("p")), T.slug(F.col("n"))).first()
    assert tuple(row) == ("typescript", "ts", "my-project")


def test_pack_lines_overlaps_and_covers():
    lines = [f"line number {i}" for i in range(100)]
    chunks = list(pack_lines(lines, 40, 8))
    assert chunks[0][0] == 1 and chunks[-1][1] == 100
    assert all(b[0] <= a[1] + 1 and b[1] > a[1] for a, b in zip(chunks, chunks[1:], strict=False))
    assert list(pack_lines([""], 10, 2)) == [(1, 1, "")]


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("a", i, 30) for i in range(5)] + [("b", 0, 500)], "g string, o long, c long")
    got = {(r[0], r[1]): r[2] for r in greedy_batches(rows, 70, "g", "o", "c").collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 0): 0}


def test_scan_and_changes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, content in (("src/a.py", "x = 1"), ("src/b.bin", "?"), ("src/.hidden.py", "h"), ("node_modules/c.js", "c"), ("d.ts", "d")):
        (tmp_path / name).write_text(content)
    found = scan_files(spark, str(tmp_path))
    assert sorted(r.absolute_path.rsplit("/", 1)[1] for r in found.collect()) == ["a.py", "d.ts"]
    assert sorted(r.path for r in found.collect()) == ["d.ts", "src/a.py"]
    stored = found.select("path", F.when(F.col("path").endswith("a.py"), F.col("hash")).otherwise("old").alias("hash"))
    assert [r.language for r in changed(found, stored).collect()] == ["typescript"]


def test_event_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    counts = session_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = counts.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from counted").first()[0] == 1000
