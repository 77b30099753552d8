"""Scanning, matching, the board log, routing and documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from recall_engine.functions import text as T
from recall_engine.operators import board, coverage, indexing, knowledge, matching, routing
from recall_engine.operators.boardlog import Board
from recall_engine.operators.chunking import pack_lines, within
from recall_engine.operators.code_chunks import chunks_of, indented_declarations
from recall_engine.operators.embedding import hashed_words
from recall_engine.sources import files, ignore, workspace
from recall_engine.streaming.board import append_events, retained, stale_stream


@pytest.mark.parametrize(
    ("rules", "path", "out"),
    [
        ("*.log", "a/b.log", True), ("*.log\n!keep.log", "a/keep.log", False), ("build2/", "build2/x.ts", True), ("build2/", "build2", False), ("/top.ts", "a/top.ts", False), ("/top.ts", "top.ts", True),
        ("a/*.ts", "a/x.ts", True), ("a/*.ts", "a/b/x.ts", False), ("a/**/x.ts", "a/b/c/x.ts", True), ("a/**/x.ts", "a/x.ts", True), ("**/t", "q/t/x", True), ("a/**", "a/b/c", True), ("x?.ts", "x1.ts", True), ("x[0-9].ts", "xa.ts", False),
        ("x[!0-9].ts", "xa.ts", True), ("# no\n\n", "no", False), ("\\#yes", "#yes", True), ("tmp/\n!tmp/in.ts", "tmp/in.ts", True), ("a.b", "axb", False), ("trail  ", "trail", True),
    ],
)
def test_ignore_rules(spark, rules, path, out):
    assert spark.range(1).select(ignore.ignored(F.lit(path), ignore.rules_of(rules)).alias("x")).first()["x"] is out


def test_scan(spark, tmp_path):
    root = tmp_path / "ws" / "app"
    for name, text in {
        "src/auth.ts": "export class Auth {}", "src/utils.ts": "export function f() {}", "Dockerfile": "FROM x", "pic.png": "x", "node_modules/m.ts": "x", "dist/d.ts": "x", "src/out.gen.ts": "x",
        ".gitignore": "*.gen.ts\n", ".hidden/h.ts": "x", "secret.py": "x", "big.ts": "y" * 3000, "note.md": "# n", "empty.md": "",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (tmp_path / "ws" / ".memoryignore").write_text("secret.*\n")
    got = {r.path: r for r in files.scan_files(spark, str(root), most_bytes=2000).collect()}
    assert sorted(got) == ["Dockerfile", "note.md", "src/auth.ts", "src/utils.ts"]
    assert got["src/auth.ts"].absolute_path == str(root / "src/auth.ts") and got["src/auth.ts"].language == "typescript"
    assert "secret.py" in {r.path for r in files.scan_files(spark, str(root), rules=[]).collect()}
    assert [r.path for r in files.scan_file(spark, str(root / "src/out.gen.ts"), str(root)).collect()] == ["src/out.gen.ts"]
    assert files.scan_file(spark, str(root / "nowhere.ts"), str(root)).count() == 0 and files.scan_file(spark, str(root / "pic.png"), str(root)).count() == 0
    with pytest.raises(NotADirectoryError):
        files.scan_files(spark, str(root / "Dockerfile"))
    held = spark.createDataFrame([("src/auth.ts", "b-1")], "resource string, holder string")
    assert files.write_file(spark, str(root), "src/auth.ts", "no", "a-1", held) == "b-1"
    assert files.write_file(spark, str(root), "src/auth.ts", "yes é", "b-1", held) is None and (root / "src/auth.ts").read_text() == "yes é"
    assert [r.name for r in files.list_documents(spark, str(root)).collect()] == ["note"]


def test_index_is_created_and_shrinks(spark, tmp_path):
    shape = "project_id string, path string, language string, hash string, content string"
    rows = spark.createDataFrame([("p", "a.py", "python", "1", "def f():\n  pass"), ("p", "b.py", "python", "2", "x = 1")], shape)
    run = lambda r, k, **kw: indexing.update_index(spark, r, str(tmp_path / "i"), hashed_words(8), F.current_timestamp(), str(tmp_path / f"s{k}"), **kw)
    assert [tuple(r)[:2] for r in run(rows, 1).collect()] == [("p", 2)]
    assert run(rows, 2).count() == 0
    run(rows.where("path = 'a.py'").withColumn("hash", F.lit("3")), 3, whole=True)
    index = indexing.read_index(spark, str(tmp_path / "i"))
    assert {(r.file_path, r.file_hash) for r in index.collect()} == {("a.py", "3")}
    assert indexing.without_files(index, index).count() == 0 and indexing.without_chunks(index, index.select("id")).count() == 0
    indexing.clear_index(spark, str(tmp_path / "i"))
    assert not indexing.index_exists(spark, str(tmp_path / "i"))


PAIRS = [
    ("Create UserDTO for authentication", "Create UserDTO for authentication", 1.0), ("Create UserDTO for authentication", "Create UserDTO for authentification", 0.9429), ("Create UserDTO for authentication", "Implement payment gateway service", 0.0909),
    ("Create user authentication service", "Create user auth service", 0.7059), ("CREATE USERDTO", "create userdto", 1.0), ("  Create   UserDTO   ", "Create UserDTO", 1.0), ("", "", 1.0), ("test", "", 0.0),
]


@pytest.mark.parametrize("least", [0, 0.3, 0.75, 0.85, 0.95, 1, 1.2])
def test_similar_texts_equal_all_pairs(spark, monkeypatch, least):
    """Random texts with random edits, of every length around the bands' ends."""
    monkeypatch.setattr(matching, "SMALL_KEY", 1)
    r = random.Random(5)
    texts = ["", "a"] + ["".join(r.choices("abc é", k=r.randrange(1, 90))) for _ in range(40)]
    for _ in range(160):
        t = list(r.choice(texts))
        for _ in range(r.randrange(1, 9)):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randrange(2)] = r.choice(["", "x", "ab"])
        texts.append("".join(t))
    texts = sorted({" ".join(t.split()) for t in texts})
    left = spark.createDataFrame([("p", t) for t in texts[::2]] + [("q", "a"), (None, "a")], "k string, a string")
    right = spark.createDataFrame([("p", t) for t in texts[1::2]] + [("q", "a"), (None, "a")], "k string, b string")
    got = sorted(tuple(x) for x in matching.similar_texts(left, right, ["k"], least).collect())
    want = left.join(right, "k").where(T.text_similarity(F.col("a"), F.col("b")) >= least)
    assert got == sorted(tuple(x) for x in want.collect())


def test_few_pairs_are_verified(spark):
    """Of a key's pairs of unlike texts of one length few share a segment."""
    r = random.Random(1)
    texts = {" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(6)) for _ in range(1500)}
    rows = spark.createDataFrame([("p", t) for t in texts], "k string, a string")
    assert matching.candidate_texts(rows, rows.withColumnRenamed("a", "b"), ["k"], 0.85).count() < 0.02 * len(texts) ** 2


@pytest.mark.parametrize("least", [0.7, 0.75, 0.85, 0.95])
def test_fuzzy_pairs_equal_all_pairs(spark, least):
    words = sorted({x for a, b, _ in PAIRS for x in (a, b)}) + ["a", "ab", "abc", "x" * 40, "x" * 47, "x" * 34 + "y" * 6]
    rows = spark.createDataFrame([(k, "p", w) for k, w in enumerate(words)] + [(99, "q", "ab"), (98, "p", None)], "i int, p string, t string")
    got = {tuple(r) for r in matching.fuzzy_pairs(rows, rows.withColumnRenamed("i", "j"), ["p"], ["t"], [least]).select("i", "j").collect()}
    both = rows.join(rows.select(F.col("i").alias("j"), "p", F.col("t").alias("u")), "p")
    want = {tuple(r) for r in both.where(T.text_similarity(F.coalesce("t", F.lit("")), F.coalesce("u", F.lit(""))) >= least).select("i", "j").collect()}
    assert got == want


def test_similarity_and_best_match(spark):
    rows = spark.createDataFrame(PAIRS, "a string, b string, s double")
    assert all(abs(r.got - r.s) < 1e-4 for r in rows.withColumn("got", T.text_similarity(F.col("a"), F.col("b"))).collect())
    targets = spark.createDataFrame([("p", "Create UserDTO with validation"), ("p", "Create UserDTO"), ("q", "same"), ("p", ""), ("r", "none here")], "p string, t string")
    them = spark.createDataFrame([("p", 0, "Implement payment service"), ("p", 1, "Create UserDTO with validations"), ("p", 2, "Setup database connection"), ("q", 5, "same"), ("q", 4, "Same")], "p string, i int, t string")
    got = {(r.p, r.t): r.match and (r.match["order"], round(r.match["score"], 4)) for r in matching.best_match(targets, them, ["p"], "t", "t", "i").collect()}
    assert got == {("p", "Create UserDTO with validation"): (1, 0.9677), ("p", "Create UserDTO"): None, ("q", "same"): (4, 1.0), ("p", ""): None, ("r", "none here"): None}


def test_python_that_does_not_parse():
    text = "import os\n\nclass A:\n    def f(self):\n        return (\n\n    async def g(self):\n        pass\n\ndef h(:\n    # c\n    x = 1\ny = 2\n"
    assert [(c.start_line, c.end_line, c.chunk_type, c.name, c.parent) for c in indented_declarations(text)] == [(3, 8, "class", "A", ""), (4, 5, "method", "f", "A"), (7, 8, "method", "g", "A"), (10, 12, "function", "h", "")]
    assert [x[3] for x in chunks_of(text, "python", 100, 125, 5)] == ["class", "method", "method", "function"]


def test_long_lines_are_cut():
    lines = ["a" * 10, "b" * 1000, "c", "d" * 150, "e" * 150]
    got = [*within(pack_lines(lines, 50, 5), 60, 5)]
    assert "".join(x for a, b, x in got if a == b == 2).startswith("b" * 1000) and all(len(x) <= 240 for *_, x in got)
    assert got[0] == (1, 1, "a" * 10) and got[-1] == (5, 5, "e" * 150) and {k for a, b, _ in got for k in range(a, b + 1)} == {1, 2, 3, 4, 5}
    assert [*within(iter([(3, 4, "x\ny")]), 60, 5)] == [(3, 4, "x\ny")]


def test_coverage(spark):
    rows = spark.createDataFrame([("a/x.ts", "ts", "1"), ("a/b/y.ts", "ts", "2"), ("a/b/z.py", "py", "3"), ("top.ts", "ts", "4")], "path string, language string, hash string")
    index = spark.createDataFrame([("a/x.ts", "1", 30), ("a/b/y.ts", "old", 12)], "path string, hash string, chunks int")
    s = coverage.file_status(rows, index)
    assert {r.path: r.status for r in s.collect()} == {"a/x.ts": "indexed", "a/b/y.ts": "pending_reindex", "a/b/z.py": "not_indexed", "top.ts": "not_indexed"}
    whole = coverage.totals(s)
    assert whole.select("total", "indexed", "pending", "missing", "percent", "chunks_a_file").first()[:] == (4, 1, 1, 2, 25.0, 42.0)
    assert {r.folder: (r.total, r.indexed) for r in coverage.tree(s).collect()} == {"a": (3, 1), "a/b": (2, 0)}
    assert [(r.folder, r.name, r.is_folder) for r in coverage.listed(s).orderBy("folder", "place").collect()] == [("", "a", True), ("", "top.ts", False), ("a", "b", True), ("a", "x.ts", False), ("a/b", "y.ts", False), ("a/b", "z.py", False)]
    assert coverage.advice(whole, coverage.by(s, "language"), coverage.by(s, "language")).first()[0] == ["low coverage: 25.0 %, index the whole project", "1 files changed since they were indexed", "languages not indexed: py", "many chunks a file: 42.0"]
    none = coverage.totals(s.limit(0))
    assert none.select("total", "percent", "chunks_a_file").first()[:] == (0, 0.0, 0.0)


def test_board_log(spark, tmp_path):
    a = Board(spark, str(tmp_path / "board"), "p")
    first = a.register_agent("coder", "s1", {"keywords": ["x"]})
    b = Board(spark, a.path, "p")
    second = b.dispatch("register", base="coder", session_id="s2")
    assert first != second and second.startswith("coder-") and a.agent_of_session("s1") == first and a.agent_of_session("none") is None
    assert {r.agent_id: r.active for r in a.agents().collect()} == {first: False, second: True}
    assert a.resolve("coder") == second and a.resolve(first) == first and a.resolve("nobody") == "nobody"
    task = a.create_task("Write é 😀", "d" * 4000)
    assert a.claim_task(task) and not b.claim_task(task)
    b.complete_task(task)
    state = a.tasks().first()
    assert (state.status, state.claimed_by, state.title, len(state.description)) == ("COMPLETED", first, "Write é 😀", 4000)
    assert a.claim("f.ts") and not b.claim("f.ts") and b.claim("g.ts")
    assert a.cleanup() == 1 and [r.resource for r in a.locks().collect()] == ["g.ts"]
    b.release()
    assert a.locks().count() == 0
    a.append("messages", sender=first, message="hi")
    assert a.recent("messages").first()["message"] == "hi" and a.forget_events().count() == 2
    assert Board(spark, a.path, "other").tasks().count() == 0 and set(a.dispatch("get_board")) == {"agents", "tasks", "locks"}
    with pytest.raises(ValueError):
        a.dispatch("fly")


def test_routing(spark, tmp_path):
    own, target = Board(spark, str(tmp_path / "b"), "p"), Board(spark, str(tmp_path / "b"), "q")
    target.create_task("Create UserDTO")
    told = []

    def reasoner(prompt):
        told.append(prompt)
        if len(told) == 1:
            return 'I ask {"tool": "look", "arguments": {"name": "q"}}'
        return json.dumps({"responsibilities": ["own part"], "delegations": [{"project": "q", "title": "create userdto", "description": "aaaa"}, {"project": "q", "title": "Setup payment", "description": "bbbb"}]})

    cards = spark.createDataFrame([("q", "Project: q")], "project_id string, card string")
    tasks = target.tasks().withColumn("project_id", F.lit("q"))
    got = routing.route_task(spark, reasoner, own, "do it", cards, tasks, {"look": lambda name: f"seen {name}"})
    assert got["action"] == "mixed" and [d["title"] for d in got["delegations"]] == ["Setup payment"] and len(got["duplicates"]) == 1 and "seen q" in told[1]
    assert own.recent("routings").first()["action"] == "mixed"
    task, there = routing.delegate_task(target, "p", "Setup payment", "desc", "ctx")
    assert not there and task.startswith("EXT-") and {r.description for r in target.tasks().collect()} == {"", "desc\n\nContext:\nctx"}
    assert routing.delegate_task(target, "p", "Setup  Payment", "x", "y") == (task, True)
    with pytest.raises(RuntimeError):
        routing.reasoned(lambda p: '{"tool": "look"}', "x", {}, most=3)
    with pytest.raises(ValueError):
        routing.reasoned(lambda p: "no object", "x", {})
    waits, tries = [], []

    def failing(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise routing.Passing
        return "ok"

    assert routing.with_retries(failing, wait=waits.append)("p") == "ok" and waits == [1.0, 2.0]


def test_documents(spark, tmp_path):
    folder = str(tmp_path / "docs")
    rows = workspace.initial_documents(spark.createDataFrame([("p", "Project", "2024-01-01")], "project_id string, title string, date string"))
    assert sorted(workspace.write_documents(spark, rows, folder)) == sorted(workspace.DOCUMENTS) and workspace.write_documents(spark, rows, folder) == []
    held = files.list_documents(spark, folder).select(F.lit("p").alias("project_id"), "name", F.col("content").alias("text"))
    asked = spark.createDataFrame([("p", "decisions"), ("p", "TechContext.md"), ("p", "nope")], "project_id string, name string")
    got = {r.name: r.text for r in workspace.asked_documents(asked, held).collect()}
    assert got["decisions"].startswith("# decisionLog: Project") and got["TechContext.md"].startswith("# techContext") and got["nope"] == "No document nope of project p"
    log = spark.createDataFrame([("# x\n",), (None,)], "t string").select(knowledge.with_entry(F.col("t"), F.lit("### 2024-01-02 - a\n")).alias("t"))
    assert [r.n for r in log.select(knowledge.decision_count(F.col("t")).alias("n")).collect()] == [1, 1]
    told = knowledge.document_summary(held, lambda p: "so " + json.dumps({"n": p.count("## ")}) + " .").first()
    assert json.loads(told.summary)["n"] > 4


def test_registry(spark, tmp_path):
    path, found = str(tmp_path / "r.json"), spark.createDataFrame([("a", "/a"), ("b", "/b")], "project_id string, path string")
    assert {r.project_id: r.status for r in workspace.read_registry(spark, path, found).collect()} == {"a": "IDLE", "b": "IDLE"}
    workspace.write_registry(spark, path, spark.createDataFrame([("z", "/z", "d", ["k"], "ACTIVE", "2024")], workspace.CARD))
    assert [tuple(r) for r in workspace.read_registry(spark, path, found).collect()] == [("z", "/z", "d", ["k"], "ACTIVE", "2024")]
    (tmp_path / "r.json").write_text("{broken")
    assert workspace.read_registry(spark, path, found).count() == 2 and (tmp_path / "r.json.bak").read_text() == "{broken"
    report = workspace.sync_report(workspace.synchronised(found.limit(1), found.withColumn("source", F.lit("index")))).first()
    assert (report.projects, report.without_card, report.listed) == (2, 1, "- b")
    (tmp_path / "w" / "x" / "y").mkdir(parents=True)
    (tmp_path / "w" / "go.mod").write_text("")
    assert workspace.workspace_root(str(tmp_path / "w" / "x" / "y")) == str(tmp_path / "w")


def test_text_functions(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS a, timestamp'2024-01-01 10:59:59' AS b, timestamp'2024-01-01 13:00:00' AS c, 'x' AS d")
    assert row.select(T.age_text(F.col("a"), F.col("b")), T.age_text(F.col("a"), F.col("c"))).first()[:] == ("59 minute(s) ago", "3 hour(s) ago")
    assert row.select(T.document_name(F.lit("My_Doc_X.md")), T.contains_all(F.lit("A  b C"), ["a B", "c"]), T.is_code_file(F.lit("x/Makefile")), T.is_code_file(F.lit("x/a.pdf"))).first()[:] == ("mydoc_x", True, True, False)


def test_event_streams(spark, tmp_path):
    shape = "event_id long, agent_id string, ts timestamp"
    rows = spark.sql("SELECT id AS event_id, concat('a', id % 2) AS agent_id, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts FROM range(5)")
    late = spark.sql("SELECT 100L AS event_id, 'a0' AS agent_id, timestamp'2024-01-02 00:00:00' AS ts")
    rows.union(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append_events(retained(source(), 2), str(tmp_path / "log"), str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [0, 1, 2, 3, 4, 100]
    q = stale_stream(source()).writeStream.format("memory").queryName("stale").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert "a1" in {r.agent_id for r in spark.table("stale").collect()}


def test_cleanup_and_cards(spark):
    agents = spark.sql("SELECT 'p' AS project_id, 'a' AS agent_id, timestamp'2024-01-01 10:00:00' AS last_seen UNION ALL SELECT 'p', 'b', timestamp'2024-01-01 09:00:00'")
    locks = spark.createDataFrame([("p", "x", "a"), ("p", "y", "b"), ("p", "z", "gone")], "project_id string, resource string, holder string")
    got = board.cleanup_events(locks, agents, F.expr("timestamp'2024-01-01 10:20:00'"))
    assert {r.resource for r in got.collect()} == {"y", "z"} and {r.action for r in got.collect()} == {"release"}


def test_scan_reads_only_what_it_keeps(spark, tmp_path):
    """Files that would fill the memory lie in ignored folders or above the limit."""
    for name in ("node_modules/a/huge.ts", "src/big.ts", ".hid/huge.ts", "gen/huge.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with open(tmp_path / name, "wb") as f:
            f.truncate(1 << 40)
    for name in ("src/a.ts", "src/_b.ts", "src/.c.ts", ".hid/d.ts", "src/deep/er/e.py", "empty.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.md" else "x")
    (tmp_path / ".gitignore").write_text("gen/\n")
    scan = lambda **kw: sorted(r.path for r in files.scan_files(spark, str(tmp_path), include_empty=True, **kw).collect())
    assert scan() == ["empty.md", "src/_b.ts", "src/a.ts", "src/deep/er/e.py"]
    assert scan(include_hidden=True) == [".gitignore", ".hid/d.ts", "empty.md", "src/.c.ts", "src/_b.ts", "src/a.ts", "src/deep/er/e.py"]
    listed = {r.path for r in files.list_files(spark, str(tmp_path), ignore.load_rules(spark, str(tmp_path)), True).collect()}
    assert not any(x.startswith(("node_modules", "gen/")) for x in listed)
    (tmp_path / "none").mkdir()
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0
