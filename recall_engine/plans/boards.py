"""Queries of the coordination board, the registry and routing.

Events are the log of a board: users are tasks, 'signup' creates, 'click' (by
the agent of its hour) claims and 'purchase' completes.  For locks, users are
resources of 20 projects; every event but 'error' and 'view' claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.operators import board, registry, vectors
from recall_engine.plans.queries import _RANKED, _SIM, _first_vector
from recall_engine.plans.registered import count, query
from recall_engine.streaming import claims


def lock_events(e: DataFrame) -> DataFrame:
    return e.select(
        (F.col("user_id") % 20).cast("string").alias("project_id"),
        F.col("user_id").cast("string").alias("resource"),
        F.concat(F.lit("agent"), (F.hour("ts") % 4).cast("string")).alias("agent_id"),
        F.when(F.col("event_type").isin("error", "view"), "release").otherwise("claim").alias("action"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


_TASKS = """
WITH log AS (SELECT user_id AS task_id, 'agent' || hour(ts) % 4 AS agent_id, event_type, (ts, event_id) AS moment, ts FROM events),
born AS (SELECT task_id, min(moment) AS born FROM log WHERE event_type = 'signup' GROUP BY task_id),
later AS (SELECT l.*, born FROM log l JOIN born USING (task_id) WHERE moment >= born),
done AS (SELECT task_id, min(moment) FILTER (event_type = 'purchase') AS first_done, max(ts) FILTER (event_type = 'purchase') AS completed_at,
         min(moment) FILTER (event_type = 'click') AS claim_at, min_by(agent_id, moment) FILTER (event_type = 'click') AS claimer FROM later GROUP BY task_id)
SELECT task_id, CASE WHEN completed_at IS NOT NULL THEN 'COMPLETED' WHEN claim_at IS NOT NULL THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status,
       CASE WHEN claim_at IS NOT NULL AND (first_done IS NULL OR claim_at < first_done) THEN claimer END AS claimed_by FROM done"""


@query("events", sql=_TASKS)
def task_board(e):
    action = F.element_at(F.create_map(*map(F.lit, ["signup", "create", "click", "claim", "purchase", "complete"])), F.col("event_type"))
    log = e.where(F.col("event_type").isin("signup", "click", "purchase")).select(F.col("user_id").alias("task_id"), action.alias("action"), F.concat(F.lit("agent"), (F.hour("ts") % 4).cast("string")).alias("agent_id"), "ts", F.col("event_id").alias("seq"))
    return board.task_states(log).select("task_id", "status", "claimed_by")


@query("events")
def lock_board(e):
    return board.held_locks(lock_events(e)).select("project_id", "resource", "holder", "since")


@query("events", sql="SELECT (user_id % 20)::VARCHAR AS project_id, arg_max('agent' || hour(ts) % 4, (ts, event_id)) AS agent_id FROM events WHERE event_type = 'signup' GROUP BY 1")
def active_agent(e):
    return board.active_agents(lock_events(e.where("event_type = 'signup'"))).select("project_id", "agent_id")


@query("events", sql="SELECT user_id FROM (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id) WHERE seen < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def stale_agent(e):
    beats = e.select(F.col("user_id").alias("agent_id"), "ts")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return board.stale_agents(beats, now).select(F.col("agent_id").alias("user_id"))


@query("events", sql="SELECT user_id, floor(date_diff('second', max(ts), TIMESTAMP '2024-02-01') / 3600)::BIGINT AS hours FROM events GROUP BY user_id")
def relative_age(e):
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", F.floor(F.expr("timestampdiff(SECOND, date_trunc('SECOND', last), TIMESTAMP_NTZ '2024-02-01 00:00:00')") / 3600).alias("hours"))


@query("conversations", sql="SELECT conv_id, turn, r::INTEGER AS r FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def recent_messages(c):
    from recall_engine.operators.knowledge import recent_history

    return recent_history(c, "conv_id", ["turn"], 3).select("conv_id", "turn", F.col("place").alias("r"))


_DUPLICATES = f"""
SELECT p.p_partkey AS proposal_id, coalesce(t.task, -1) AS duplicate_of FROM (SELECT * FROM part WHERE p_size % 2 = 0) p LEFT JOIN (
  SELECT a.p_partkey, max(b.p_partkey) AS task FROM part a JOIN part b ON a.p_brand = b.p_brand
  WHERE a.p_size % 2 = 0 AND b.p_size % 2 = 1 AND ({_SIM.format(a='lower(a.p_name)', b='lower(b.p_name)')} >= 0.85 OR {_SIM.format(a="lower(a.p_type || ' ' || a.p_name)", b="lower(b.p_type || ' ' || b.p_name)")} >= 0.75)
  GROUP BY 1) t ON p.p_partkey = t.p_partkey"""


def _checked_proposals(p: DataFrame) -> DataFrame:
    text = [F.col("p_brand").alias("project_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_name").alias("description")]
    proposals = p.where("p_size % 2 = 0").select(*text, F.col("p_partkey").alias("proposal_id"))
    tasks = p.where("p_size % 2 = 1").select(*text, F.col("p_partkey").alias("task_id"), F.col("p_partkey").alias("created_at"))
    return board.first_duplicate(proposals, tasks)


@query("part", sql=_DUPLICATES)
def route_duplicates(p):
    """-1: no task is nearly the same."""
    return _checked_proposals(p).select("proposal_id", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


@query("part", sql=f"SELECT p_brand AS project_id, count(*) FILTER (duplicate_of < 0) AS valid, count(*) FILTER (duplicate_of >= 0) AS duplicates, CASE WHEN count(*) FILTER (duplicate_of < 0) = 0 THEN 'proceed' ELSE 'delegate' END AS action FROM ({_DUPLICATES}) JOIN part ON p_partkey = proposal_id GROUP BY 1")
def route_actions(p):
    return board.routing_decision(_checked_proposals(p), "project_id")


@query("orders", "customer", sql="SELECT o_orderkey, coalesce(c_name, 'unknown') AS target FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def delegation_targets(o, c):
    cards = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return o.join(cards, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("target"))


@query("customer", sql="SELECT c_nationkey, arg_max(c_name, c_custkey) FILTER (c_acctbal >= 0) AS c_name, arg_max(c_mktsegment, c_custkey) FILTER (c_acctbal < 5000) AS c_mktsegment FROM customer GROUP BY c_nationkey")
def merge_cards(c):
    log = c.select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("").alias("c_name"), F.when(F.col("c_acctbal") < 5000, F.col("c_mktsegment")).alias("c_mktsegment"))
    return registry.merge_cards(log, "c_nationkey", ["c_name", "c_mktsegment"], F.col("c_custkey"))


@query("supplier", sql="SELECT s_suppkey, md5('Project: ' || s_name || chr(10) || 'Nation: ' || s_nationkey) AS card FROM supplier")
def card_texts(s):
    return s.select("s_suppkey", F.md5(registry.card_text({"s_name": "Project", "s_nationkey": "Nation"})).alias("card"))


@query("embeddings", "customer", sql=f"SELECT rank::INTEGER AS rank, c_name, round(1 - d, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY d, vec_id) AS rank FROM ({_RANKED}) ORDER BY d, vec_id LIMIT 10) JOIN customer ON c_custkey = vec_id")
def ranked_cards(e, c):
    found = registry.ranked_cards(e, _first_vector(e), c.withColumnRenamed("c_custkey", "vec_id"), "vec_id")
    return found.select("rank", "c_name", F.round("score", 6).alias("score"))


@query("part", sql="SELECT p_partkey FROM part WHERE contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget')")
def discover_fallback(p):
    """No ranked card: the text decides."""
    return registry.discover(p, ["p_name", "p_type"], "Widget", None).select("p_partkey")


@query("supplier", "nation", sql="SELECT n_name, md5(string_agg('- ' || s_name, chr(10) ORDER BY s_suppkey)) AS context FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def routing_context(s, n):
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"])
    listed = F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("- "), "s_name").alias("line"))))
    return rows.groupBy("n_name").agg(F.md5(F.array_join(F.transform(listed, lambda x: x["line"]), "\n")).alias("context"))


@query("embeddings", "documents", sql=f"SELECT vec_id, round(score, 2) AS score, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM (SELECT *, greatest(0, 1 - d / 2) AS score FROM (SELECT * FROM ({_RANKED}) ORDER BY d, vec_id LIMIT 5)) JOIN documents ON doc_id = vec_id WHERE score >= 0.5")
def search_preview(e, d):
    hits = vectors.top_k(e, _first_vector(e), 5, 0.5).select("vec_id", "score")
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return d.join(F.broadcast(hits), d["doc_id"] == hits["vec_id"]).select("vec_id", F.round("score", 2).alias("score"), preview.alias("preview"))


@query("documents", "labels", sql="SELECT count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars % 2 <> l.quality")
def pending_changes(d, labels):
    return d.join(labels, "doc_id").where(F.col("n_chars") % 2 != F.col("quality")).agg(count().alias("n"))


_CLAIMS = """
WITH RECURSIVE r AS (SELECT user_id, event_id, 'agent' || hour(ts) % 4 AS agent, CASE event_type WHEN 'view' THEN 'write' WHEN 'error' THEN 'release' ELSE 'claim' END AS action, event_id % 3 + 1 AS shown, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, FALSE AS granted, NULL::VARCHAR AS holder, 0::BIGINT AS token, 0::BIGINT AS until, 0::BIGINT AS clock FROM r
UNION ALL
SELECT user_id, k, event_id, taken OR shows, CASE WHEN taken THEN agent WHEN shows AND action = 'release' THEN NULL ELSE h END, CASE WHEN taken AND h IS NULL THEN token + 1 ELSE token END, CASE WHEN taken THEN c + 172800000 ELSE until END, c
FROM (SELECT *, action = 'claim' AND (h IS NULL OR h = agent) AS taken, coalesce(action <> 'claim' AND h = agent AND shown = token, FALSE) AS shows
      FROM (SELECT s.user_id, r.k, r.event_id, r.agent, r.action, r.shown, s.token, s.until, greatest(s.clock, r.ms) AS c, CASE WHEN greatest(s.clock, r.ms) < s.until THEN s.holder END AS h FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)))
SELECT event_id, granted, coalesce(holder, '') AS holder, CASE WHEN holder IS NOT NULL THEN token ELSE 0 END AS grant_token FROM s WHERE k > 0"""


@query("events", sql=_CLAIMS)
def claim_tokens(e):
    """Users as resources, events as requests of the agent of their hour: views
    write and errors release with a token that may be stale, the others claim
    for two days."""
    action = F.when(F.col("event_type") == "view", "write").when(F.col("event_type") == "error", "release").otherwise("claim")
    log = e.select(F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("resource"), F.concat(F.lit("agent"), (F.hour("ts") % 4).cast("string")).alias("agent_id"), action.alias("action"), (F.col("event_id") % 3 + 1).alias("token"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return claims.claim_log(log, 2 * 24 * 60).select(F.col("seq").alias("event_id"), "granted", F.coalesce("holder", F.lit("")).alias("holder"), F.coalesce("grant_token", F.lit(0)).alias("grant_token"))
