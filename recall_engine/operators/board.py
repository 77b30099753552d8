"""The coordination board as logs: agents, tasks and locks are views of events.

Each log has a time ``ts`` and a sequence ``seq`` that settles ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.operators.folds import ordered_fold
from recall_engine.operators.matching import last_alike


def active_agents(log: DataFrame) -> DataFrame:
    """(project_id, agent_id, since): the last agent registered for a project is
    its active one; those before are inactive."""
    last = F.struct("ts", "seq")
    return log.groupBy("project_id").agg(F.max_by("agent_id", last).alias("agent_id"), F.max("ts").alias("since"))


def stale_agents(heartbeats: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """(agent_id, last_seen) of agents not heard of for ``minutes``."""
    seen = heartbeats.groupBy("agent_id").agg(F.max("ts").alias("last_seen"))
    return seen.where(F.col("last_seen") < now - F.make_dt_interval(mins=F.lit(minutes)))


def task_states(log: DataFrame) -> DataFrame:
    """State of each task from a log of (task_id, action, agent_id, ts, seq).

    A claim counts only while the task is pending: the first one after its
    creation and before any completion.  Completion counts from any state, the
    last one stands.  Actions before the creation, and tasks never created,
    don't count.
    """
    at = F.struct("ts", "seq")

    def first(action: str) -> Column:
        return F.min(F.when(F.col("action") == action, at))

    created = log.groupBy("task_id").agg(first("create").alias("created")).where("created IS NOT NULL")
    later = log.join(created, "task_id").where(at >= F.col("created"))
    done = later.groupBy("task_id").agg(
        F.first("created").alias("created"),
        first("complete").alias("first_done"),
        F.max(F.when(F.col("action") == "complete", F.col("ts"))).alias("completed_at"),
        F.min(F.when(F.col("action") == "claim", F.struct("ts", "seq", "agent_id"))).alias("claim"),
    )
    claimed = F.col("claim").isNotNull() & (F.col("first_done").isNull() | (F.struct("claim.ts", "claim.seq") < F.col("first_done")))
    return done.select(
        "task_id",
        F.when(F.col("completed_at").isNotNull(), "COMPLETED").when(claimed, "IN_PROGRESS").otherwise("PENDING").alias("status"),
        F.when(claimed, F.col("claim.agent_id")).alias("claimed_by"),
        F.col("created.ts").alias("created_at"),
        F.when(claimed, F.col("claim.ts")).alias("claimed_at"),
        "completed_at",
    )


def lock_step(holder, action: str, agent) -> tuple:
    """(holder after, granted): a claim fails while another holds the lock, the
    holder's own claim renews it; only the holder releases it."""
    if action == "claim":
        return (agent, True) if holder is None or holder == agent else (holder, False)
    return (None, True) if holder is not None and holder == agent else (holder, False)


def lock_log(log: DataFrame) -> DataFrame:
    """Adds (granted, holder) to a log of (project_id, resource, agent_id, action, ts, seq)."""

    def step(holder, row):
        holder, granted = lock_step(holder, row.action, row.agent_id)
        return holder, (granted, holder)

    return ordered_fold(log, ["project_id", "resource"], ["ts", "seq"], "granted boolean, holder string", lambda: None, step)


def held_locks(log: DataFrame) -> DataFrame:
    """(project_id, resource, holder, since) of the locks held at the end of a log."""
    told = lock_log(log)
    last = told.groupBy("project_id", "resource").agg(
        F.max_by("holder", F.struct("ts", "seq")).alias("holder"),
        F.max(F.when(F.col("granted") & (F.col("action") == "claim"), F.col("ts"))).alias("since"),
    )
    return last.where("holder IS NOT NULL")


def orphaned_locks(locks: DataFrame, agents: DataFrame) -> DataFrame:
    """Locks whose holder is no active agent of the project."""
    active = agents.select("project_id", F.col("agent_id").alias("holder"))
    return locks.join(active, ["project_id", "holder"], "left_anti")


def first_duplicate(proposals: DataFrame, tasks: DataFrame, title: float = 0.85, description: float = 0.75) -> DataFrame:
    """Proposals (project_id, proposal_id, title, description) with
    ``duplicate_of``: the latest task (by created_at, then id) of that project
    whose title or description is nearly the same; null if there is none."""
    found = last_alike(proposals, tasks, ["project_id"], ["title", "description"], [title, description], F.struct("created_at", "task_id"))
    return found.select(*proposals.columns, F.col("last.task_id").alias("duplicate_of"))


def delegated(proposals: DataFrame, tasks: DataFrame, title: float = 0.85) -> DataFrame:
    """(project_id, proposal_id, task_id, is_duplicate, status, description) of
    proposals (project_id, proposal_id, title, description, context): the latest
    task of nearly the same title stands for a proposal, with its status;
    others become pending tasks whose description holds the context."""
    found = last_alike(proposals, tasks, ["project_id"], ["title"], [title], F.struct("created_at", "task_id", "status")).withColumnRenamed("last", "old")
    text = F.concat(F.coalesce("description", F.lit("")), F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")))
    return found.select(
        "project_id", "proposal_id", F.col("old.task_id").alias("task_id"), F.col("old").isNotNull().alias("is_duplicate"), F.coalesce("old.status", F.lit("PENDING")).alias("status"), F.when(F.col("old").isNull(), text).alias("description")
    )


def cleanup_events(locks: DataFrame, agents: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """(project_id, resource, agent_id, action) to append to a lock log: releases
    of locks (project_id, resource, holder) whose holder isn't active or wasn't
    heard of for ``minutes``.  agents: (project_id, agent_id, last_seen) of the
    active ones."""
    alive = agents.where(F.col("last_seen") >= now - F.make_dt_interval(mins=F.lit(minutes))).select("project_id", F.col("agent_id").alias("holder"))
    return locks.join(alive, ["project_id", "holder"], "left_anti").select("project_id", "resource", F.col("holder").alias("agent_id"), F.lit("release").alias("action"))


def resolved_agents(asked: DataFrame, agents: DataFrame) -> DataFrame:
    """asked (name) with ``agent_id``: the agent of that id, else the one last
    seen whose id is the name with a dash and more, else the name itself.

    agents: (agent_id, last_seen).  Names meet agents by each part of their id
    that ends before a dash."""
    exact = agents.select(F.col("agent_id").alias("name"), F.lit(True).alias("_exact")).distinct()
    parts = F.split("agent_id", "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "-"))
    bases = agents.where(F.size(parts) > 1).select(F.explode(heads).alias("name"), "agent_id", "last_seen")
    latest = bases.groupBy("name").agg(F.max_by("agent_id", F.struct("last_seen", "agent_id")).alias("_latest"))
    return asked.join(exact, "name", "left").join(latest, "name", "left").select(*asked.columns, F.when(F.col("_exact"), F.col("name")).otherwise(F.coalesce("_latest", "name")).alias("agent_id"))


def with_cards(agents: DataFrame, cards: DataFrame, fields: list[str]) -> DataFrame:
    """Agents with the fields of their project's card; null without a card."""
    return agents.join(cards.select("project_id", *fields), "project_id", "left")


def routing_decision(checked: DataFrame, by: str, own: DataFrame | None = None) -> DataFrame:
    """(by, valid, duplicates, action): 'proceed' when nothing is left to
    delegate, 'mixed' where ``own`` (by, responsibilities) has work left for the
    project itself beside what is delegated, else 'delegate'."""
    counted = checked.groupBy(by).agg(F.count_if(F.col("duplicate_of").isNull()).alias("valid"), F.count("duplicate_of").alias("duplicates"))
    counted = counted.withColumn("responsibilities", F.lit(0)) if own is None else counted.join(own, by, "left")
    action = F.when(F.col("valid") == 0, "proceed").when(F.coalesce("responsibilities", F.lit(0)) > 0, "mixed").otherwise("delegate")
    return counted.select(by, "valid", "duplicates", action.alias("action"))
