import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_engine import plans
from recall_engine.operators import code_chunks as C
from recall_engine.operators import embedding, indexing, knowledge
from recall_engine.streaming.board import follow_files

SF = "/root/testdata/sf0.001"
PYTHON = '''import os

@cached
def one(a):
    return a


class Two:
    def three(self):
        def four():
            pass
'''
TYPESCRIPT = '''import { a } from "b";
// tools
export class AuthService {
  async login(name: string): Promise<void> {
    if (name === "}") { return; }
  }
}

export const plus = (a: number, b: number) => {
  return a + b;
};
interface Shape {
  size: number;
}
'''
FILES = "project_id string, path string, language string, hash string, content string"


def test_python_declarations():
    assert [(c.chunk_type, c.name, c.parent, c.start_line, c.end_line) for c in C.python_declarations(PYTHON)] == [
        ("function", "one", "", 3, 5),
        ("class", "Two", "", 8, 11),
        ("method", "three", "Two", 9, 11),
        ("function", "four", "three", 10, 11),
    ]


def test_braced_declarations():
    assert [(c.chunk_type, c.name, c.parent, c.start_line, c.end_line) for c in C.braced_declarations(TYPESCRIPT)] == [
        ("class", "AuthService", "", 3, 7),
        ("method", "login", "AuthService", 4, 6),
        ("function", "plus", "", 9, 11),
        ("interface", "Shape", "", 12, 14),
    ]


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_code_chunks_and_their_limits(spark):
    long = "def f():\n" + "\n".join(f"    x{i} = {i}" for i in range(500))
    rows = [("p", "a.py", "python", "h", PYTHON), ("p", "b.py", "python", "h", "def broken(:"), ("p", "c.css", "css", "h", "a{}"), ("p", "d.py", "python", "h", None), ("p", "e.py", "python", "h", long)]
    got = C.code_chunks(files(spark, rows), 500, 625, 20).collect()
    by = lambda path: [r for r in got if r.file_path == path]
    assert len(by("a.py")) == 4 and by("a.py")[0].context == "import os"
    assert [(r.chunk_type, r.content) for r in by("b.py") + by("c.css") + by("d.py")] == [("function", "def broken(:"), ("file", "a{}"), ("file", "")]  # what doesn't parse is scanned by lines
    parts = by("e.py")
    assert len(parts) > 1 and all(r.token_count <= 500 for r in parts) and parts[0].name == "f_part1"
    assert parts[0].start_line == 1 and parts[-1].end_line == 501
    assert C.code_chunks(files(spark, []), 500).count() == 0


def test_cached_vectors_are_not_made_again(spark):
    embed = embedding.hashed_words(16)
    chunks = spark.createDataFrame([("a", "one text"), ("b", "two"), ("c", None)], "id string, content string")
    none = spark.createDataFrame([], "chunk_id string, content_hash string, model string, vector array<float>")
    rows, cache = embedding.embed_with_cache(chunks, none, "m", embed)
    assert rows.count() == cache.count() == 3
    changed = chunks.withColumn("content", F.when(F.col("id") == "b", "new").otherwise(F.col("content")))
    rows, fresh = embedding.embed_with_cache(changed.where("id <> 'c'"), cache, "m", embed)
    assert [r.chunk_id for r in fresh.collect()] == ["b"] and rows.count() == 2
    assert embedding.embed_with_cache(changed, cache, "other", embed)[1].count() == 3
    assert embedding.cache_stats(cache).first().vectors == 3


def test_text_search_equals_brute_force(spark):
    embed = embedding.hashed_words()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    text = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    v = embed([d.text or "" for d in docs]).astype(float)
    q = embed([text])[0].astype(float)
    d2 = ((v - q) ** 2).sum(axis=1)
    best = sorted(zip(np.round(d2, 9), [d.doc_id for d in docs], strict=True))[:10]
    got = plans.QUERIES["text_search"](spark, SF).collect()
    assert {r.doc_id for r in got} == {d for _, d in best}
    with pytest.raises(ValueError, match="blank"):
        indexing.search(None, "  ", embed)


def test_index_follows_changes(spark, tmp_path):
    embed = embedding.hashed_words(16)
    first = files(spark, [("p", "a.py", "python", "h1", PYTHON), ("q", "a.py", "python", "h1", "x = 1")])
    path = str(tmp_path / "index")
    indexing.write_index(indexing.index_rows(first, embed, F.lit("2024-01-01").cast("timestamp")), path)
    again = files(spark, [("p", "a.py", "python", "h2", "def new():\n    pass"), ("p", "b.py", "python", "h1", "y = 2"), ("q", "a.py", "python", "h1", "x = 1")])
    run = indexing.update_index(spark, again, path, embed, F.current_timestamp(), str(tmp_path / "s1"))
    assert [tuple(r) for r in run.collect()] == [("p", 2, 2)]
    index = indexing.read_index(spark, path)
    assert sorted((r.project_id, r.file_path, r.name) for r in index.collect()) == [("p", "a.py", "new"), ("p", "b.py", ""), ("q", "a.py", "")]
    assert indexing.search(index, "def new pass", embed, 5, 0.1, language="python", file="a.py").first().name == "new"
    assert indexing.changed_files(again, index).count() == 0 and indexing.changed_files(again, index, force=True).count() == 3


def test_index_follows_a_stream(spark, tmp_path):
    embed = embedding.hashed_words(16)
    path = str(tmp_path / "index")
    indexing.write_index(indexing.index_rows(files(spark, [("p", "a.py", "python", "h1", "x = 1")]), embed, F.current_timestamp()), path)
    files(spark, [("p", "a.py", "python", "h2", "x = 3"), ("p", "b.py", "python", "h1", "y")]).write.parquet(str(tmp_path / "in"))
    q = follow_files(spark.readStream.schema(FILES).parquet(str(tmp_path / "in")), path, embed, str(tmp_path / "s"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert sorted((r.file_path, r.content) for r in indexing.read_index(spark, path).collect()) == [("a.py", "x = 3"), ("b.py", "y")]


def test_markdown(spark):
    text = "# Progress\n\n## Completed\n- [x] One\n- [X]  Two \n\n## Next\n- [ ] Three\n\n## Log\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | |\n"
    row = spark.createDataFrame([(text,)], "t string").select(
        knowledge.checklist(knowledge.section(F.col("t"), "Completed"), True).alias("done"),
        knowledge.checklist(F.col("t"), False).alias("open"),
        knowledge.table_rows(knowledge.section(F.col("t"), "Log")).alias("cells"),
        knowledge.json_object(F.lit("so {\"a\": {\n}} end")).alias("json"),
        knowledge.json_object(F.lit("none")).alias("none"),
    ).first()
    assert (row.done, row.open, row.cells, row.json, row.none) == (["One", "Two"], ["Three"], [["1", "2"], ["3", ""]], '{"a": {\n}}', None)


def test_summaries_fit(spark):
    rows = spark.createDataFrame([("p", i, "f", "word " * 400) for i in range(20)] + [("q", 0, "f", "short"), ("q", 1, "f", None)], "project_id string, seq long, path string, content string")
    out = knowledge.summarise_to_budget(rows, knowledge.first_characters(400), threshold=1000, most=2000)
    got = {r.project_id: (r.n, r.c) for r in out.groupBy("project_id").agg(F.count("seq").alias("n"), F.sum(F.length("content")).alias("c")).collect()}
    assert got["q"] == (2, 5) and got["p"][1] <= 4000


def test_summaries_leave_a_trace_of_every_document(spark):
    """Each document's sentence of frequent words stands at its end, and all meet in few batches."""
    rows = [("p", i, "f", f"Filler goes ahead. {'x y z. ' * 60}The topic{i} topic{i} topic{i} matters.") for i in range(120)]
    table = spark.createDataFrame(rows, "project_id string, seq long, path string, content string")
    for depth in (1, 3):
        out = knowledge.summarise_to_budget(table, knowledge.Extract(200), threshold=1500, most=2000, depth=depth)
        text = " ".join(r.content for r in out.collect())
        assert all(re.search(rf"\btopic{i}\b", text) for i in range(120)) and len(text) <= 4 * 1500
    assert knowledge.Extract(10)("") == "" and knowledge.Extract(10).batch("\n") == ""
    assert knowledge.Extract(30)("One is here. A word word word. Another.") == "One is here. A word word word."
