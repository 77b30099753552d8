"""Routing of tasks to projects by a reasoner, and delegation.

A reasoner is any function from a prompt to a text.  What it may ask for in
between are tools, named functions of JSON arguments.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.operators import board
from recall_engine.operators.boardlog import Board


class Reasoner(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Passing(Exception):
    """An error of a remote model that may pass: too many requests, or its own."""


def with_retries(call: Reasoner, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> Reasoner:
    """The call, made again after 1, 2, 4... seconds when it raises Passing; the
    last error and all others are raised."""

    def run(prompt: str) -> str:
        for k in range(attempts):
            try:
                return call(prompt)
            except Passing:
                if k == attempts - 1:
                    raise
                wait(2.0**k)
        raise ValueError("attempts must be positive")

    return run


def json_of(text: str) -> dict | None:
    """The object from the first opening to the last closing brace."""
    found = re.search(r"\{.*\}", text, re.S)
    try:
        value = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def reasoned(reasoner: Reasoner, prompt: str, tools: dict[str, Callable[..., object]], most: int = 100) -> dict:
    """The reasoner's answer: an object without a tool in it.  As long as it
    names a tool, the tool's result joins the prompt, at most ``most`` times."""
    told = prompt
    for _ in range(most):
        answer = json_of(reasoner(told))
        if answer is None:
            raise ValueError("the answer holds no JSON object")
        if "tool" not in answer:
            return answer
        tool = tools.get(answer["tool"])
        try:
            result = tool(**answer.get("arguments", {})) if tool else f"no tool {answer['tool']}"
        except (TypeError, ValueError) as e:
            result = f"failed: {e}"
        told += f"\n\n{answer['tool']}: {json.dumps(result, default=str)}"
    raise RuntimeError(f"no answer after {most} calls of tools")


def route_task(spark: SparkSession, reasoner: Reasoner, own: Board, task: str, cards: DataFrame, tasks: DataFrame, tools: dict[str, Callable[..., object]] | None = None, most: int = 100) -> dict:
    """What of a task is the project's own and what others do.

    cards: (project_id, card); their texts are the prompt's context, so pass
    those worth asking for (registry.ranked_cards or discover), not all.  The
    reasoner answers {"responsibilities": [...], "delegations": [{"project",
    "title", "description"}]}.  Delegations whose title or description is
    nearly that of a task of the target go; action is 'proceed' where none is
    left, 'mixed' where the project keeps work beside, else 'delegate'.  The
    outcome goes to the routing log.
    """
    listed = cards.agg(F.array_join(F.array_sort(F.collect_list("card")), "\n\n").alias("text")).first()["text"]
    answer = reasoned(reasoner, f"Project: {own.project_id}\nTask: {task}\n\nProjects:\n{listed}\n\nAnswer with a JSON object.", tools or {}, most)
    wanted = [(x.get("project"), k, x.get("title", ""), x.get("description", "")) for k, x in enumerate(answer.get("delegations", []))]
    proposals = spark.createDataFrame(wanted, "project_id string, proposal_id int, title string, description string")
    checked = board.first_duplicate(proposals, tasks).orderBy("proposal_id").collect() if wanted else []
    kept = [r for r in checked if r["duplicate_of"] is None]
    mine = list(answer.get("responsibilities", []))
    action = "proceed" if not kept else "mixed" if mine else "delegate"
    out = {
        "action": action,
        "responsibilities": mine,
        "delegations": [{"project": r["project_id"], "title": r["title"], "description": r["description"]} for r in kept],
        "duplicates": [{"project": r["project_id"], "title": r["title"], "task_id": r["duplicate_of"]} for r in checked if r["duplicate_of"] is not None],
    }
    own.save_routing(task, action, json.dumps(out))
    return out


def delegate_task(target: Board, from_project: str, title: str, description: str, context: str) -> tuple[str, bool]:
    """(task id, whether it was there already): creates the task on the target's
    board unless one of nearly the same title is on it."""
    proposal = target.spark.createDataFrame([(target.project_id, 0, title, description, context)], "project_id string, proposal_id int, title string, description string, context string")
    old = target.tasks().withColumn("project_id", F.lit(target.project_id))
    found = board.delegated(proposal, old).first()
    if found["is_duplicate"]:
        return found["task_id"], True
    return target.create_task(title, found["description"], from_project), False
