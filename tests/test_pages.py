"""Rendered pages, the progress of a project, cards and caches."""

import datetime
import json

import numpy as np
from pyspark.sql import functions as F

from recall_engine.operators import embedding, indexing, knowledge, pages, progress, registry
from recall_engine.sources import files


def update(spark, project="p", **fields):
    names = [x.split()[0] for x in progress.UPDATE.split(", ")]
    return spark.createDataFrame([tuple({"project_id": project, **fields}.get(n) for n in names)], progress.UPDATE)


def page(spark, text, project="p"):
    return spark.createDataFrame([(project, text)], "project_id string, text string")


def lists(df):
    return df.select(*(c.alias(n) for n, c in progress.parsed_progress(F.col("text")).items())).first()


def test_progress_begins_and_goes_on(spark):
    first = progress.track_progress(page(spark, None), update(spark, in_progress=["Build", "build", "Test"], blocked=["Key"], upcoming=["Ship"], blockers=[("high", "No key"), (None, None)], phase="Alpha"), F.lit("2024-05-01"))
    row = first.first()
    assert row.updated == ["In Progress", "Blocked", "Upcoming", "Phase", "Blockers"] and row.created == ["Build", "build", "Test"]
    assert (row.n_completed, row.n_in_progress, row.n_blocked, row.n_upcoming, row.n_milestones, row.n_blockers) == (0, 2, 1, 1, 0, 2)
    assert "### Blocked\n- [ ] ⚠️ Key" in row.text and "- 🔴 **HIGH**: No key\n- 🟡 **LOW**: " in row.text and "**Last Updated**: 2024-05-01" in row.text
    then = progress.track_progress(page(spark, row.text), update(spark, completed=["BUILD"], in_progress=["Test", "Docs"], milestone=("Initial setup", "Done", None, "")), F.lit("2024-05-01"))
    row = then.first()
    got = lists(then)
    assert got.completed == [progress.FIRST_TASK, "BUILD"] and got.in_progress == ["Test", "Docs"] and got.upcoming == ["Ship"]
    assert [tuple(m) for m in got.milestones] == [("Initial setup", "Done", "-", "-")] and (got.phase, got.phase_status) == ("Alpha", "In Progress")
    assert row.created == ["Docs"] and "Blocked\n" not in row.text and row.updated == ["Completed", "In Progress", "Milestones"]


def test_progress_without_content(spark):
    same = progress.track_progress(page(spark, ""), update(spark, phase="", in_progress=[]), F.lit("2024-05-01")).first()
    assert same.updated == [] and same.created == [] and same.n_completed == 0
    assert progress.track_progress(page(spark, "x", "other"), update(spark), F.lit("2024-05-01")).count() == 0
    assert progress.track_progress(page(spark, "x").limit(0), update(spark).limit(0), F.lit("2024-05-01")).count() == 0
    tasks = progress.track_progress(page(spark, None), update(spark, in_progress=[f"t{k}" for k in range(50)]), F.lit("2024-05-01"))
    made = progress.created_tasks(tasks, "a-1", F.lit("2024-05-01").cast("timestamp")).collect()
    assert len({r.task_id for r in made}) == 50 and [r.title for r in sorted(made, key=lambda r: r.seq)] == [f"t{k}" for k in range(50)]


def test_milestones_keep_their_place(spark):
    kept = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("Open").alias("status"), F.lit("-").alias("target"), F.lit("-").alias("notes")) for n in ("One", "Two", "two")))
    new = lambda n: F.struct(F.lit(n).alias("name"), F.lit("Done").alias("status"), F.lit("May").alias("target"), F.lit(None).cast("string").alias("notes"))
    got = spark.range(1).select(progress.with_milestone(kept, new("TWO")).alias("a"), progress.with_milestone(kept, new("Three")).alias("b"), progress.with_milestone(kept, F.lit(None).cast(progress.MILESTONE)).alias("c")).first()
    assert [(m.name, m.status) for m in got.a] == [("One", "Open"), ("TWO", "Done"), ("two", "Open")]
    assert [m.name for m in got.b] == ["One", "Two", "two", "Three"] and [m.name for m in got.c] == ["One", "Two", "two"]


def test_board_page(spark):
    ts = "cast(ts as timestamp)"
    agents = spark.createDataFrame([("p", "a-1", "ACTIVE", None, "s", "2024-01-01 10:00:00"), ("p", "b-2", "ACTIVE", "x|y", None, "2024-01-01 11:00:00")], "project_id string, agent_id string, status string, focus string, session_id string, last_seen string")
    tasks = spark.createDataFrame([("p", "T2", "two", None, "PENDING", "2024-01-02"), ("p", "T1", "one", "", "PENDING", "2024-01-01"), ("q", "T3", "three", "z", "PENDING", None)], "project_id string, task_id string, title string, sender string, status string, created_at string")
    locks = spark.createDataFrame([], "project_id string, resource string, holder string, since timestamp")
    messages = spark.createDataFrame([("p", f"2024-01-01 00:00:{k:02}", k, "a-1", f"m{k}") for k in range(25)], "project_id string, ts string, seq long, agent_id string, message string").withColumn("ts", F.expr(ts))
    got = {r.project_id: r.text.split("\n") for r in pages.board_page(agents, tasks, locks, messages).collect()}
    assert set(got) == {"p", "q"}
    p = got["p"]
    assert p[5:7] == ["| b-2 | ACTIVE | x|y |  | 2024-01-01 11:00:00 |", "| a-1 | ACTIVE |  | s | 2024-01-01 10:00:00 |"]
    assert [x for x in p if x.startswith("| T")] == ["| T1 | one | - | PENDING | 2024-01-01 |", "| T2 | two | - | PENDING | 2024-01-02 |"]
    assert [x for x in p if x.startswith("- [")] == [f"- [00:00:{k:02}] **a-1**: m{k}" for k in range(5, 25)]
    assert "| T3 | three | z | PENDING |  |" in got["q"] and not [x for x in got["q"] if x.startswith("- [")]
    assert pages.board_page(agents.limit(0), tasks.limit(0), locks, messages.limit(0)).count() == 0


def test_documents_page_takes_the_latest(spark):
    docs = spark.createDataFrame([("p", "b", "# t\n\none\n \ntwo\n3\n4\n5\n6", "2024-01-01"), ("p", "b", "old\nold", "2023-01-01"), ("p", "a", None, None), ("p", "z", "x\ny", "2024-01-01")], "project_id string, type string, text string, generated_at string")
    got = {r.project_id: r.text for r in pages.documents_page(spark.createDataFrame([("p",), ("p",), ("q",)], "project_id string"), docs, {"a": "First", "b": "Second"}).collect()}
    assert got["p"] == "# Project Documentation Summary\n\n## First\n*Last generated: Unknown*\n\n\n\n---\n\n## Second\n*Last generated: 2024-01-01T00:00:00.000Z*\n\none\ntwo\n3\n4\n5\n\n---\n\n"
    assert set(got) == {"p", "q"} and got["q"].startswith("No documents")


def test_prompt_above_its_budget_is_summarised(spark):
    rows = [("p", k, f"d/f{k}.py", "python", "file", None, f"The number {k} is told. " * 40) for k in range(8)] + [("q", 1, "x/README.md", None, None, "", None), ("q", 0, "a.py", "python", "class", "A", "pass")]
    chunks = spark.createDataFrame(rows, "project_id string, seq long, path string, language string, chunk_type string, name string, content string")
    got = {r.project_id: r for r in pages.prompt_texts(chunks, knowledge.Extract(200), most=5, threshold=600, batch=300).collect()}
    assert got["p"].summarised and len(got["p"].text) < 4 * 600 and not got["q"].summarised
    assert got["q"].text == "--- File: x/README.md () [] ---\n\n---\n\n--- File: a.py (python) [class: A] ---\npass\n---"
    whole = {r.project_id: r.text for r in pages.prompt_texts(chunks, knowledge.Extract(200), most=5).collect()}
    assert [x for x in whole["p"].split("\n") if x.startswith("--- File")] == [f"--- File: d/f{k}.py (python) [file] ---" for k in range(5)]
    assert pages.prompt_texts(chunks.limit(0), knowledge.Extract(200)).count() == 0


def test_registrations_embed_what_changed(spark):
    schema = "project_id string, description string, keywords array<string>, responsibilities array<string>, owns array<string>, project_type string, exports string, path string, ts timestamp"
    at = lambda k: datetime.datetime(2024, 1, k)
    log = spark.createDataFrame([("a", "first", ["x", "y"], ["r1", "r2"], None, "LIB", "e", "/a", at(1)), ("b", None, None, None, None, None, None, "/b", at(1))], schema)
    empty = log.limit(0).withColumnRenamed("ts", "last_active")
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        return np.ones((len(texts), 2), np.float32)

    first, made = registry.register_projects(empty, log, spark.createDataFrame([], embedding.CACHE), "m", embed)
    cards = {r.project_id: r for r in first.collect()}
    assert seen.value == 2 and cards["a"].content == "Project: a\nDescription: first\nKeywords: x, y\nResponsibilities: r1. r2\nType: LIB\nExports: e" and cards["b"].content == "Project: b\nDescription: \nKeywords: "
    held, made = spark.createDataFrame(first.collect(), first.schema), spark.createDataFrame(made.collect(), made.schema)
    before = seen.value
    again = spark.createDataFrame([("a", "", [], [], ["own"], None, " ", None, at(3))], schema)
    second = {r.project_id: r for r in registry.register_projects(held, again, made, "m", embed)[0].collect()}
    assert seen.value == before + 1 and second["a"].owns == ["own"] and second["a"].description == "first" and second["a"].path == "/a" and second["a"].last_active == at(3) and second["b"].last_active == at(1)


def test_search_is_logged(spark):
    found = spark.createDataFrame([(f"f{k}", "c" * 250, "file", None, k / 10) for k in range(7)], "file_path string, content string, chunk_type string, name string, score double")
    row = indexing.search_event(found, "p", "s", "a", 'say "x"', F.lit("2024-01-01").cast("timestamp"), file="src").first()
    data = json.loads(row.data)
    assert row.event_type == "search" and data["query"] == 'say "x"' and data["filters"] == {"file": "src"} and data["resultCount"] == 7
    assert [x["path"] for x in data["topResults"]] == ["f6", "f5", "f4", "f3", "f2"]
    none = json.loads(indexing.search_event(found.limit(0), "p", "s", "a", "q", F.current_timestamp()).first().data)
    assert none["resultCount"] == 0 and none["topResults"] == []
    shown = indexing.search_snippets(found).where("file = 'f3'").first()
    assert shown.score == "0.30" and shown.preview == "c" * 200 + "..."


def test_cache_is_kept_and_cleared(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert embedding.load_cache(spark, path).count() == 0
    rows = spark.createDataFrame([("c", "h", "m", [1.0]), ("c", "h2", "m", [2.0])], embedding.CACHE)
    embedding.save_cache(rows, path)
    embedding.save_cache(rows, path)
    assert embedding.load_cache(spark, path).count() == 2
    embedding.clear_cache(spark, path)
    embedding.clear_cache(spark, path)
    assert embedding.load_cache(spark, path).count() == 0


def test_own_folder_is_not_scanned(spark, tmp_path):
    for name in ("a.py", "idx/b.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    assert [r.path for r in files.scan_files(spark, str(tmp_path), own="idx").collect()] == ["a.py"]
    assert files.scan_files(spark, str(tmp_path)).count() == 2
