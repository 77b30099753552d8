"""Board logs as streams: locks held by key, and an index that follows files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recall_engine.operators import store
from recall_engine.operators.board import lock_step
from recall_engine.operators.embedding import Embedder
from recall_engine.operators.indexing import update_index


def lock_stream(log: DataFrame) -> DataFrame:
    """Each event of a stream (project_id, resource, agent_id, action, ts, seq)
    with (granted, holder); the state of a lock is its holder.  Events of one
    micro-batch are taken by ts and seq."""
    names = ["project_id", "resource", "agent_id", "action", "ts", "seq"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values(["ts", "seq"])
        out = []
        for row in rows[names].itertuples(index=False):
            holder, granted = lock_step(holder, row.action, row.agent_id)
            out.append((*row, granted, holder))
        state.update((holder,))
        yield pd.DataFrame(out, columns=[*names, "granted", "holder"])

    fields = "project_id string, resource string, agent_id string, action string, ts timestamp, seq long"
    rows = log.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in fields.split(", ")))
    return rows.groupBy("project_id", "resource").applyInPandasWithState(run, f"{fields}, granted boolean, holder string", "holder string", "append", GroupStateTimeout.NoTimeout)


def follow_files(files: DataFrame, index_path: str, embedder: Embedder, staging: str, checkpoint: str):
    """A stream of files (project_id, path, language, hash, content, mtime) brought
    into the index batch by batch; of several versions of a file in a batch the
    latest counts, and a batch run again finds its files unchanged."""

    def put(batch: DataFrame, batch_id: int) -> None:
        latest = F.struct("mtime", "hash") if "mtime" in batch.columns else F.struct("hash")
        last = batch.groupBy("project_id", "path").agg(F.max_by(F.struct(*batch.columns), latest).alias("x")).select("x.*")
        run = f"{staging}/{batch_id}-{pd.Timestamp.now().value}"
        update_index(batch.sparkSession, last, index_path, embedder, F.current_timestamp(), run)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """A stream of events appended to a log of Parquet files, each exactly once."""
    return events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def retained(events: DataFrame, days: int = 30, seq: str = "event_id") -> DataFrame:
    """Each event of a stream once, whatever its source repeats: what is known of
    an event is forgotten ``days`` after the latest one, and events older than
    that are left out."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{days} days")
    return stamped.dropDuplicatesWithinWatermark([seq])


def stale_stream(heartbeats: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(agent_id, last_seen) of agents of a stream (agent_id, ts) once event time
    has passed their last heartbeat by ``minutes``; their state is dropped then."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"agent_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="ms")]})
            return
        last = max([int(f["ms"].max()) for f in frames] + ([state.get[0]] if state.exists else []))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    stamped = heartbeats.select(F.col("agent_id").cast("string").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return stamped.withColumn("ms", F.unix_millis("ts")).groupBy("agent_id").applyInPandasWithState(run, "agent_id string, last_seen timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def follow_into_store(files: DataFrame, path: str, embedder: Embedder, checkpoint: str, least_dead: float = 0.3):
    """A stream of files (project_id, path, language, hash, content, deleted, and
    mtime) brought into a store (operators.store) batch by batch.

    The latest version of a file in a batch counts; one that is ``deleted``
    leaves.  A batch run again finds its files unchanged.  A batch writes its own
    files, and the store is compacted once ``least_dead`` of it doesn't count."""

    def put(batch: DataFrame, batch_id: int) -> None:
        latest = F.struct(*[c for c in ("mtime", "hash") if c in batch.columns])
        last = batch.groupBy("project_id", "path").agg(F.max_by(F.struct(*batch.columns), latest).alias("x")).select("x.*")
        gone = F.coalesce("deleted", F.lit(False))
        spark = batch.sparkSession
        store.update_store(spark, last.where(~gone).drop("deleted"), path, embedder, F.current_timestamp(), removed=last.where(gone))
        store.compact_store(spark, path, least_dead)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
