"""Claims: one holder at a time, rising tokens, leases, the stream as a replay."""

import datetime
import random

from pyspark.sql import functions as F

from recall_engine.streaming import claims

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def requests(n, seed):
    r, rows, shown = random.Random(seed), [], {}
    for seq in range(n):
        key, agent = r.choice("xy"), r.choice("abc")
        action = r.choice(["claim", "claim", "write", "renew", "release", "odd"])
        # clocks differ by minutes, tokens may be stale
        rows.append(("p", key, agent, action, r.choice([None, *range(12)]), START + datetime.timedelta(minutes=seq + r.randrange(-9, 9)), seq))
        shown[key] = agent
    return rows


def replay(rows, minutes):
    """By a plain dictionary: (holder, token, until, clock) of each resource."""
    state, out = {}, {}
    for p, key, agent, action, token, ts, seq in sorted(rows, key=lambda r: r[6]):
        holder, last, until, clock = state.get(key, (None, 0, START, START - datetime.timedelta(days=1)))
        clock = max(clock, ts)
        if holder and clock >= until:
            holder = None
        ok = False
        if action == "claim" and holder in (None, agent):
            last, until, ok = last + (holder is None), clock + datetime.timedelta(minutes=minutes), True
            holder = agent
        elif holder == agent and token == last and action in ("write", "renew", "release"):
            ok = True
            if action == "renew":
                until = clock + datetime.timedelta(minutes=minutes)
            if action == "release":
                holder = None
        state[key] = (holder, last, until, clock)
        out[seq] = (ok, holder, last if holder else None)
    return out


def test_log_equals_a_replay(spark):
    rows = requests(600, 1)
    got = {r.seq: (r.granted, r.holder, r.grant_token) for r in claims.claim_log(spark.createDataFrame(rows, claims.REQUEST).repartition(5), 6).collect()}
    assert got == replay(rows, 6)
    assert claims.claim_log(spark.createDataFrame([], claims.REQUEST)).count() == 0


def test_a_slow_clock_gets_no_second_grant(spark):
    later, sooner = START + datetime.timedelta(seconds=2), START
    rows = [("p", "r", "a", "claim", None, later, 1), ("p", "r", "b", "claim", None, sooner, 2), ("p", "r", "b", "write", 1, sooner, 3), ("p", "r", "a", "write", 1, later, 4), ("p", "r", "a", "release", 1, later, 5), ("p", "r", "b", "claim", None, sooner, 6), ("p", "r", "a", "write", 1, later, 7)]
    got = {r.seq: (r.granted, r.holder, r.grant_token) for r in claims.claim_log(spark.createDataFrame(rows, claims.REQUEST)).collect()}
    assert got == {1: (True, "a", 1), 2: (False, "a", 1), 3: (False, "a", 1), 4: (True, "a", 1), 5: (True, None, None), 6: (True, "b", 2), 7: (False, "b", 2)}


def test_stream_equals_the_log(spark, tmp_path):
    rows, at = requests(120, 3), str(tmp_path / "in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", claims.ROCKSDB)
    try:
        for part in (rows[:70], rows[70:]):
            spark.createDataFrame(part, claims.REQUEST).repartition(2).write.mode("append").parquet(at)
            stream = spark.readStream.schema(claims.REQUEST).parquet(at)
            out = claims.claim_stream(stream, 6, "1 day")
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        late = [("p", "z", "a", "claim", None, START + datetime.timedelta(days=4), 999)]
        spark.createDataFrame(late, claims.REQUEST).write.mode("append").parquet(at)
        claims.claim_stream(spark.readStream.schema(claims.REQUEST).parquet(at), 6, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    want = replay(rows, 6)
    assert {r.seq: (r.granted, r.holder, r.grant_token) for r in found if r.action != "expire" and r.seq != 999} == want
    held = {r[1] for r in rows if want[max(x[6] for x in rows if x[1] == r[1])][1]}
    assert {r.resource for r in found if r.action == "expire"} == held
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("action") == "expire").count() == len(held)
