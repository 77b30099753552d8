"""The board of a workspace: logs in Parquet that are only appended to, and views.

A call appends a row or two; views are the folds of operators.board over the
logs.  Logs are partitioned by nothing and hold events only, so writers on many
machines can append at once.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.operators import board

LOGS = {
    "agents": "project_id string, agent_id string, session_id string, keywords array<string>, responsibilities array<string>, status string, ts timestamp, seq long",
    "tasks": "project_id string, task_id string, action string, agent_id string, title string, description string, from_project string, ts timestamp, seq long",
    "locks": "project_id string, resource string, agent_id string, action string, ts timestamp, seq long",
    "events": "project_id string, session_id string, agent_id string, event_type string, data string, ts timestamp, seq long",
    "messages": "project_id string, sender string, message string, ts timestamp, seq long",
    "routings": "project_id string, routing_id string, task string, action string, result string, success boolean, ts timestamp, seq long",
}


def suffixed(base: str) -> str:
    """A new agent id: the base, a dash and eight hex digits."""
    return f"{base}-{uuid.uuid4().hex[:8]}"


@dataclass
class Board:
    """path: a folder that all writers share; project_id, agent_id: who calls."""

    spark: SparkSession
    path: str
    project_id: str = "default"
    agent_id: str | None = None

    def _now(self) -> datetime.datetime:
        return datetime.datetime.now(datetime.timezone.utc)

    def log(self, name: str) -> DataFrame:
        """All rows of a log; none where nothing was written yet."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(place):
            return self.spark.createDataFrame([], LOGS[name])
        return self.spark.read.schema(LOGS[name]).parquet(f"{self.path}/{name}")

    def mine(self, name: str) -> DataFrame:
        return self.log(name).where(F.col("project_id") == self.project_id)

    def append(self, name: str, **values) -> None:
        at = self._now()
        row = {"project_id": self.project_id, "ts": at, "seq": int(at.timestamp() * 1_000_000), **values}
        fields = [x.split()[0] for x in LOGS[name].split(", ")]
        self.spark.createDataFrame([tuple(row.get(c) for c in fields)], LOGS[name]).write.mode("append").parquet(f"{self.path}/{name}")

    # agents
    def register_agent(self, base: str, session_id: str | None = None, card: dict | None = None) -> str:
        """The project's new active agent; those before become inactive, as the
        last one registered counts.  Keywords and responsibilities come from the card."""
        card = card or {}
        self.agent_id = suffixed(base)
        self.append("agents", agent_id=self.agent_id, session_id=session_id, keywords=card.get("keywords", []), responsibilities=card.get("responsibilities", []), status="ACTIVE")
        self.append("events", session_id=session_id, agent_id=self.agent_id, event_type="register", data=None)
        return self.agent_id

    def resolve(self, name: str) -> str:
        asked = self.spark.createDataFrame([(name,)], "name string")
        return board.resolved_agents(asked, self.mine("agents").groupBy("agent_id").agg(F.max("ts").alias("last_seen"))).first()["agent_id"]

    def set_status(self, name: str, status: str) -> str:
        """A heartbeat with a status."""
        agent = self.resolve(name)
        self.append("agents", agent_id=agent, status=status)
        return agent

    def agents(self) -> DataFrame:
        """(project_id, agent_id, last_seen, status, active) of all agents."""
        log = self.mine("agents")
        active = board.active_agents(log.where("session_id IS NOT NULL OR keywords IS NOT NULL")).select("project_id", "agent_id", F.lit(True).alias("_active"))
        seen = log.groupBy("project_id", "agent_id").agg(F.max("ts").alias("last_seen"), F.max_by("status", F.struct("ts", "seq")).alias("status"))
        return seen.join(active, ["project_id", "agent_id"], "left").withColumn("active", F.coalesce("_active", F.lit(False))).drop("_active")

    def agent_of_session(self, session_id: str) -> str | None:
        found = self.log("agents").where(F.col("session_id") == session_id).agg(F.max_by("agent_id", F.struct("ts", "seq")).alias("a")).first()
        return found["a"]

    # tasks
    def create_task(self, title: str, description: str = "", from_project: str | None = None) -> str:
        """A pending task; one from another project gets the prefix of external ones."""
        task = f"{'EXT' if from_project else 'TASK'}-{uuid.uuid4().hex[:12]}"
        self.append("tasks", task_id=task, action="create", agent_id=self.agent_id, title=title, description=description, from_project=from_project)
        return task

    def claim_task(self, task_id: str) -> bool:
        """Whether this agent holds the task afterwards: the first claim counts."""
        self.append("tasks", task_id=task_id, action="claim", agent_id=self.agent_id)
        state = self.tasks().where(F.col("task_id") == task_id).first()
        return bool(state) and state["claimed_by"] == self.agent_id

    def complete_task(self, task_id: str) -> None:
        self.append("tasks", task_id=task_id, action="complete", agent_id=self.agent_id)

    def tasks(self) -> DataFrame:
        """States of the project's tasks with their title and description."""
        log = self.mine("tasks")
        what = log.where("action = 'create'").groupBy("task_id").agg(*(F.min_by(c, F.struct("ts", "seq")).alias(c) for c in ("title", "description", "from_project")))
        return board.task_states(log).join(what, "task_id")

    # locks
    def claim(self, resource: str) -> bool:
        self.append("locks", resource=resource, agent_id=self.agent_id, action="claim")
        return self.locks().where((F.col("resource") == resource) & (F.col("holder") == self.agent_id)).count() > 0

    def release(self, resource: str | None = None) -> None:
        """Gives back one resource, or all that this agent holds."""
        held = self.locks().where(F.col("holder") == self.agent_id)
        for row in (held if resource is None else held.where(F.col("resource") == resource)).toLocalIterator():
            self.append("locks", resource=row["resource"], agent_id=self.agent_id, action="release")

    def locks(self) -> DataFrame:
        return board.held_locks(self.mine("locks"))

    def cleanup(self, minutes: int = 30) -> int:
        """Releases the locks of agents that aren't active or are stale; how many."""
        alive = self.agents().where("active")
        out = board.cleanup_events(self.locks(), alive, F.lit(self._now()), minutes).withColumns({"ts": F.lit(self._now()), "seq": F.lit(int(self._now().timestamp() * 1_000_000))})
        n = out.count()
        if n:
            out.select(*self.log("locks").columns).write.mode("append").parquet(f"{self.path}/locks")
        return n

    # history
    def recent(self, name: str, most: int = 20) -> DataFrame:
        """The latest rows of a log, the newest first."""
        return self.mine(name).orderBy(F.desc("ts"), F.desc("seq")).limit(most)

    def save_routing(self, task: str, action: str, result: str, success: bool = True) -> str:
        routing = uuid.uuid4().hex
        self.append("routings", routing_id=routing, task=task, action=action, result=result, success=success)
        return routing

    def forget_events(self, days: int = 30) -> DataFrame:
        """The project's events of the last days: what a compaction writes anew."""
        return self.mine("events").where(F.col("ts") >= F.lit(self._now()) - F.make_dt_interval(days=F.lit(days)))

    def dispatch(self, action: str, **values):
        """One of the actions that tools name."""
        actions = {
            "register": self.register_agent,
            "update_status": self.set_status,
            "claim_resource": self.claim,
            "release_resource": self.release,
            "get_board": lambda: {name: view() for name, view in (("agents", self.agents), ("tasks", self.tasks), ("locks", self.locks))},
            "claim_task": self.claim_task,
            "complete_task": self.complete_task,
            "create_task": self.create_task,
        }
        if action not in actions:
            raise ValueError(f"unknown action {action}: one of {', '.join(actions)}")
        return actions[action](**values)
