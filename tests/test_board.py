import pytest
from pyspark.sql import functions as F

from recall_engine import plans
from recall_engine.operators import board, registry
from recall_engine.operators.board import lock_step
from recall_engine.plans.boards import lock_events
from recall_engine.streaming.board import lock_stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def replay(log):
    holders, told = {}, {}
    for r in sorted(log, key=lambda r: (r.ts, r.seq)):
        holders[r.project_id, r.resource], granted = lock_step(holders.get((r.project_id, r.resource)), r.action, r.agent_id)
        told[r.seq] = granted, holders[r.project_id, r.resource]
    return holders, told


@pytest.mark.parametrize(
    ("holder", "action", "agent", "after"),
    [(None, "claim", "a", ("a", True)), ("a", "claim", "b", ("a", False)), ("a", "claim", "a", ("a", True)), ("a", "release", "b", ("a", False)), ("a", "release", "a", (None, True)), (None, "release", "a", (None, False))],
)
def test_lock_step(holder, action, agent, after):
    assert lock_step(holder, action, agent) == after


def test_locks_equal_a_replay(spark):
    log = lock_events(spark.read.parquet(EVENTS))
    holders, told = replay(log.collect())
    assert {r.seq: (r.granted, r.holder) for r in board.lock_log(log).collect()} == told
    held = {(r.project_id, r.resource): r.holder for r in plans.QUERIES["lock_board"](spark, "/root/testdata/sf0.001").collect()}
    assert held == {k: v for k, v in holders.items() if v}


def test_lock_log_in_small_batches_and_empty(spark):
    log = lock_events(spark.read.parquet(EVENTS))
    _, told = replay(log.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r.seq: (r.granted, r.holder) for r in board.lock_log(log).collect()} == told
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert board.lock_log(log.limit(0)).count() == 0


def test_lock_stream_equals_a_replay(spark, tmp_path):
    spark.read.parquet(EVENTS).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    _, told = replay(lock_events(spark.read.parquet(EVENTS)).collect())
    q = lock_stream(lock_events(source)).writeStream.format("memory").queryName("locks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert {r.seq: (r.granted, r.holder) for r in spark.table("locks").collect()} == told


def test_task_states(spark):
    rows = [
        ("a", "create", "x", 1), ("a", "claim", "x", 2), ("a", "claim", "y", 3),
        ("b", "create", "x", 1), ("b", "complete", "x", 2), ("b", "claim", "y", 3),
        ("c", "claim", "x", 1), ("c", "create", "x", 2),
        ("d", "claim", "x", 1),
    ]
    log = spark.createDataFrame([(*r, r[3]) for r in rows], "task_id string, action string, agent_id string, ts long, seq long")
    got = {r.task_id: (r.status, r.claimed_by) for r in board.task_states(log).collect()}
    assert got == {"a": ("IN_PROGRESS", "x"), "b": ("COMPLETED", None), "c": ("PENDING", None)}


def test_orphaned_locks(spark):
    locks = spark.createDataFrame([("p", "r1", "a"), ("p", "r2", "b"), ("q", "r1", "a")], "project_id string, resource string, holder string")
    agents = spark.createDataFrame([("p", "a")], "project_id string, agent_id string")
    assert sorted((r.project_id, r.resource) for r in board.orphaned_locks(locks, agents).collect()) == [("p", "r2"), ("q", "r1")]


def test_first_duplicate_takes_the_latest_task_and_collapses_space(spark):
    proposals = spark.createDataFrame([("p", 1, "Create   the    UserDTO", "x" * 20), ("p", 2, "Something else", "y" * 20), ("q", 3, "Create the UserDTO", "")], "project_id string, proposal_id long, title string, description string")
    tasks = spark.createDataFrame([("p", 10, 1, "create the userdto", "a"), ("p", 11, 2, "Create the UserDTOs", "b"), ("p", 12, 3, "Unrelated", "c")], "project_id string, task_id long, created_at long, title string, description string")
    got = {r.proposal_id: r.duplicate_of for r in board.first_duplicate(proposals, tasks).collect()}
    assert got == {1: 11, 2: None, 3: None}
    checked = board.first_duplicate(proposals.where("proposal_id = 1"), tasks)
    assert board.routing_decision(checked, "project_id").first().action == "proceed"


def test_cards(spark):
    log = spark.createDataFrame([("p", 1, "first", ["a"]), ("p", 2, "", []), ("p", 3, None, ["b"])], "project_id string, at long, description string, owns array<string>")
    card = registry.merge_cards(log, "project_id", ["description", "owns"], F.col("at")).first()
    assert (card.description, card.owns) == ("first", ["b"])
    assert log.where(registry.matches_text(["description", "owns"], "FIRST")).count() == 1
    assert registry.discover(log, ["description"], " ", None).count() == 3
    assert registry.discover(log, ["description"], "first", log.limit(0)).count() == 1
