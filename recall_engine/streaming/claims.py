"""Exclusive claims with fencing tokens.

All requests for a resource go through the state of its key, in the order of the
log that carries them, so one at a time is granted whatever the clocks of those
who ask.  Each grant to a new holder has a token higher than all before; who
writes to the resource shows it, and a token that isn't the latest is refused.
A claim is a lease: it ends once the key's clock, the latest time seen in its
requests, has passed it, and with the stream's watermark even without requests.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recall_engine.operators.folds import ordered_fold

REQUEST = "project_id string, resource string, agent_id string, action string, token long, ts timestamp, seq long"
ANSWER = "granted boolean, holder string, grant_token long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Claim(NamedTuple):
    holder: str | None = None
    token: int = 0
    until: int = 0
    clock: int = 0


def claim_step(state: Claim, action: str, agent: str, token: int | None, ms: int, lease_ms: int) -> tuple[Claim, bool]:
    """(state after, granted) of a request: 'claim' takes a free or expired
    resource, or prolongs one's own; 'renew', 'write' and 'release' need the
    token of a lease that still holds.  Other actions are refused."""
    clock = max(state.clock, ms)
    state = state._replace(clock=clock, holder=state.holder if clock < state.until else None)
    held = state.holder is not None
    if action == "claim":
        if held and state.holder != agent:
            return state, False
        return state._replace(holder=agent, token=state.token + (not held), until=clock + lease_ms), True
    mine = held and state.holder == agent and state.token == token
    if action == "renew" and mine:
        state = state._replace(until=clock + lease_ms)
    elif action == "release" and mine:
        state = state._replace(holder=None)
    return state, mine and action in ("renew", "release", "write")


def _answer(state: Claim, granted: bool) -> tuple:
    return bool(granted), state.holder, None if state.holder is None else state.token


def claim_log(log: DataFrame, minutes: int = 30) -> DataFrame:
    """A log of requests (REQUEST) with (granted, holder, grant_token): who holds
    the resource after each, with which token.  ``seq`` is the log's order and
    settles all ties; null actions and times are refused and don't move clocks."""
    rows = log.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in REQUEST.split(", "))).withColumn("ms", F.coalesce(F.unix_millis("ts"), F.lit(0)))

    def step(state: Claim, row) -> tuple[Claim, tuple]:
        token = None if pd.isna(row.token) else int(row.token)
        state, granted = claim_step(state, row.action or "", row.agent_id, token, int(row.ms), minutes * 60_000)
        return state, _answer(state, granted)

    return ordered_fold(rows, ["project_id", "resource"], ["seq"], ANSWER, Claim, step).drop("ms")


class _Claims(StatefulProcessor):
    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", "holder string, token long, until long, clock long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = Claim(*self.state.get()) if self.state.exists() else Claim()
        before, out = state.until, []
        for row in pd.concat(rows).sort_values("seq").itertuples(index=False):
            token = None if pd.isna(row.token) else int(row.token)
            state, granted = claim_step(state, row.action or "", row.agent_id, token, int(row.ms), self.lease_ms)
            out.append((*key, row.agent_id, row.action, int(row.seq), *_answer(state, granted)))
        self.state.update(tuple(state))
        if state.until != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(state.until)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = Claim(*self.state.get())
        if state.holder is not None and state.until <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(tuple(state._replace(holder=None)))
            yield _frame([(*key, state.holder, "expire", None, True, None, None)])

    def close(self) -> None:
        pass


_OUT = "project_id string, resource string, agent_id string, action string, seq long, granted boolean, holder string, grant_token long"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")])
    return frame.astype({"seq": "Int64", "grant_token": "Int64"})


def claim_stream(requests: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """The answers of claim_log for a stream of requests, and a row 'expire' for
    each lease that the watermark passes.  Requests of one micro-batch are taken
    by seq; the session must use the state store ROCKSDB."""
    rows = requests.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in REQUEST.split(", "))).withColumn("ms", F.coalesce(F.unix_millis("ts"), F.lit(0)))
    keyed = rows.withWatermark("ts", late).groupBy("project_id", "resource")
    return keyed.transformWithStateInPandas(_Claims(minutes * 60_000), _OUT, "Append", "EventTime")
