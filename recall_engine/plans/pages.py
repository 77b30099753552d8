"""Queries of rendered pages, registrations with their embeddings, and searches
that are logged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.operators import embedding, indexing, knowledge, pages, progress, registry
from recall_engine.operators.ranges import shared_folder
from recall_engine.plans.queries import _RANKED, _first_vector
from recall_engine.plans.registered import count, query

_BOARD = """
WITH e AS (SELECT (user_id % 20)::VARCHAR AS p, user_id AS u, 'agent' || hour(ts) % 4 AS a, date_trunc('second', ts)::TIMESTAMP AS t, event_id, event_type AS k FROM events),
lines AS (
  SELECT p, 0 AS part, -epoch_us(max(t)) AS o, a AS tie, '| ' || a || ' | ACTIVE | ' || arg_max(k, event_id) || ' |  | ' || strftime(max(t), '%Y-%m-%d %H:%M:%S') || ' |' AS line FROM e GROUP BY p, a
  UNION ALL SELECT p, 1, epoch_us(min(t)), u::VARCHAR, '| ' || u || ' | User ' || u || ' | - | PENDING | ' || strftime(min(t), '%Y-%m-%d %H:%M:%S') || ' |' FROM e GROUP BY p, u HAVING count(*) FILTER (k = 'purchase') = 0
  UNION ALL SELECT p, 2, epoch_us(arg_max(t, event_id)), u::VARCHAR, '| ' || u || ' | ' || arg_max(a, event_id) || ' | ' || strftime(arg_max(t, event_id), '%Y-%m-%d %H:%M:%S') || ' |' FROM e GROUP BY p, u HAVING arg_max(k, event_id) = 'click'
  UNION ALL SELECT p, 3, -r, a, '- [' || strftime(t, '%H:%M:%S') || '] **' || a || '**: ' || k FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY t DESC, event_id DESC) AS r FROM e) WHERE r <= 20),
parts AS (SELECT p, part, string_agg(line || chr(10), '' ORDER BY o, tie, line) AS body FROM lines GROUP BY p, part)
SELECT p AS project_id, md5('# Multi-Agent Board' || chr(10)
  || chr(10) || '## Active Agents' || chr(10) || '| Agent ID | Status | Current Focus | Session ID | Last Heartbeat |' || chr(10) || '|---|---|---|---|---|' || chr(10) || coalesce(max(body) FILTER (part = 0), '')
  || chr(10) || '## Pending Tasks' || chr(10) || '| ID | Title | From | Status | Created At |' || chr(10) || '|---|---|---|---|---|' || chr(10) || coalesce(max(body) FILTER (part = 1), '')
  || chr(10) || '## File Locks' || chr(10) || '| File Pattern | Claimed By | Since |' || chr(10) || '|---|---|---|' || chr(10) || coalesce(max(body) FILTER (part = 2), '')
  || chr(10) || '## Agent Messages' || chr(10) || coalesce(max(body) FILTER (part = 3), '')) AS page
FROM parts GROUP BY p"""


@query("events", sql=_BOARD)
def board_page(e):
    """Boards of 20 projects: the agent of an event is that of its hour, users
    that bought nothing are pending tasks, and those whose last event is a click
    are locks of the agent that clicked."""
    rows = e.select((F.col("user_id") % 20).cast("string").alias("project_id"), "user_id", F.concat(F.lit("agent"), (F.hour("ts") % 4).cast("string")).alias("agent_id"), F.date_trunc("second", "ts").alias("ts"), F.col("event_id").alias("seq"), "event_type")
    agents = rows.groupBy("project_id", "agent_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", "seq").alias("focus")).withColumns({"status": F.lit("ACTIVE"), "session_id": F.lit(None).cast("string")})
    users = rows.groupBy("project_id", "user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("bought"), F.min("ts").alias("created_at"), F.max_by(F.struct("event_type", "agent_id", "ts"), "seq").alias("x"))
    tasks = users.where("bought = 0").select("project_id", F.col("user_id").alias("task_id"), F.concat(F.lit("User "), "user_id").alias("title"), F.lit(None).cast("string").alias("sender"), F.lit("PENDING").alias("status"), "created_at")
    locks = users.where("x.event_type = 'click'").select("project_id", F.col("user_id").alias("resource"), F.col("x.agent_id").alias("holder"), F.col("x.ts").alias("since"))
    return pages.board_page(agents, tasks, locks, rows.withColumnRenamed("event_type", "message")).select("project_id", F.md5("text").alias("page"))


_FIRST = "list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i)"
_LISTS = "list(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderkey % 2 = {odd} AND o_orderstatus = '{status}')"
_PROGRESS = f"""
WITH raw AS (SELECT o_custkey AS c, {', '.join(f"coalesce({_LISTS.format(odd=odd, status=s)}, []) AS {n}{odd}" for odd in (1, 0) for s, n in (('F', 'f'), ('O', 'o'), ('P', 'p')))},
             count(*) FILTER (o_orderkey % 2 = 1) AS n1, count(*) FILTER (o_orderkey % 2 = 0) AS n0 FROM orders GROUP BY 1),
low AS (SELECT c, n0, f1, o1, p1, list_transform(f0, lambda x: lower(x)) AS f0, list_transform(o0, lambda x: lower(x)) AS o0, list_transform(p0, lambda x: lower(x)) AS p0 FROM raw),
one AS (SELECT *, CASE WHEN len(f1) = 0 THEN ['Project initialization'] ELSE f1 END AS f, {_FIRST.format(x='o1')} AS o FROM low),
two AS (SELECT *, CASE WHEN n0 = 0 THEN f ELSE f || f0 END AS fa, CASE WHEN n0 = 0 THEN o ELSE list_filter(o, lambda x: NOT list_contains(f0, lower(x))) || o0 END AS oa, p1 || p0 AS pa FROM one)
SELECT c AS o_custkey, array_to_string({_FIRST.format(x='fa')}, '|') AS done, array_to_string({_FIRST.format(x='oa')}, '|') AS under_way, array_to_string({_FIRST.format(x='pa')}, '|') AS planned,
  CASE WHEN n0 = 0 THEN '' ELSE concat_ws(',', CASE WHEN len(f0) > 0 THEN 'Completed' END, CASE WHEN len(o0) > 0 THEN 'In Progress' END, CASE WHEN len(p0) > 0 THEN 'Upcoming' END, 'Milestones') END AS updated,
  CASE WHEN n0 = 0 THEN 0 ELSE len(list_filter(o0, lambda x: NOT list_contains(list_transform(o, lambda y: lower(y)), x))) END AS n_created,
  CASE WHEN n0 = 0 THEN 'Initial Setup:In Progress' ELSE 'Initial Setup:Done' END AS milestone FROM two"""


def _updates(o: DataFrame, title, status: str | None) -> DataFrame:
    of = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == s, F.struct("o_orderkey", title.alias("t"))))), lambda x: x["t"])
    none = lambda kind: F.lit(None).cast(kind)
    milestone = none(progress.MILESTONE) if status is None else F.struct(F.lit("initial setup").alias("name"), F.lit(status).alias("status"), none("string").alias("target"), none("string").alias("notes"))
    found = o.groupBy(F.col("o_custkey").alias("project_id")).agg(of("F").alias("completed"), of("O").alias("in_progress"), of("P").alias("upcoming"))
    return found.select("*", F.array().cast("array<string>").alias("blocked"), milestone.alias("milestone"), none("array<struct<severity:string,description:string>>").alias("blockers"), none("string").alias("phase"), none("string").alias("phase_status"))


@query("orders", sql=_PROGRESS)
def tracked_progress(o):
    """Pages of customers after two updates: orders of odd keys, then those of
    even ones in lower case, with their priorities as titles.  Lists are parsed
    from the last page."""
    date = F.lit("2024-01-01")
    begun = o.select(F.col("o_custkey").alias("project_id"), F.lit(None).cast("string").alias("text")).distinct()
    odd, title = F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority")
    # a customer without odd orders gets an empty update
    first = progress.track_progress(begun, _updates(o.withColumn("o_orderstatus", F.when(odd, F.col("o_orderstatus"))), title, None), date)
    second = progress.track_progress(first.select("project_id", "text"), _updates(o.where(~odd), F.lower(title), "Done"), date)
    last = first.select("project_id", F.col("text").alias("_before")).join(second.select("project_id", "text", "updated", F.size("created").cast("long").alias("created")), "project_id", "left").withColumn("text", F.coalesce("text", "_before"))
    found = progress.parsed_progress(F.col("text"))
    joined = {n: F.array_join(found[c], "|") for n, c in (("done", "completed"), ("under_way", "in_progress"), ("planned", "upcoming"))}
    milestones = F.array_join(F.transform(found["milestones"], lambda m: F.concat(m["name"], F.lit(":"), m["status"])), "|")
    # the given name of a milestone stands from then on
    return last.select(F.col("project_id").alias("o_custkey"), *(c.alias(n) for n, c in joined.items()), F.coalesce(F.array_join("updated", ","), F.lit("")).alias("updated"), F.coalesce("created", F.lit(0)).alias("n_created"), F.regexp_replace(milestones, "^initial setup", "Initial Setup").alias("milestone"))


_TITLES = {"brief": "Project Brief", "product": "Product Context", "patterns": "System Patterns", "tech": "Tech Context", "active": "Active Context"}
_KINDS = [*_TITLES, "other"]
_DOCUMENTS_PAGE = f"""
WITH d AS (SELECT doc_id // 6 AS p, (doc_id % 6)::INTEGER AS k, doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[2:6], chr(10)) AS preview FROM documents),
s AS (SELECT p, string_agg('## ' || {list(_TITLES.values())}[k + 1] || chr(10) || '*Last generated: ' || strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z*' || chr(10) || chr(10) || preview || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY k) AS body FROM d WHERE k < 5 GROUP BY p)
SELECT q.p AS project_id, md5(CASE WHEN body IS NULL THEN 'No documents were generated for this project yet.' ELSE '# Project Documentation Summary' || chr(10) || chr(10) || body END) AS page FROM (SELECT DISTINCT p FROM d UNION ALL SELECT -1) q LEFT JOIN s ON s.p = q.p"""


@query("documents", sql=_DOCUMENTS_PAGE)
def documents_page(d):
    """Six documents a project, one of them of no known type; project -1 has none."""
    project = F.floor(F.col("doc_id") / 6)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = d.select(project.alias("project_id"), kind.alias("type"), "text", F.timestamp_seconds("doc_id").alias("generated_at"))
    projects = rows.select("project_id").union(d.sparkSession.createDataFrame([(-1,)], "project_id long"))
    return pages.documents_page(projects, rows, _TITLES).select("project_id", F.md5("text").alias("page"))


_PATHS = ["src/package.json", "README.md", "lib/Index.ts", "main.py", "x/app.js", "util.ts", "main/notes.md"]
_PROMPTS = f"""
WITH c AS (SELECT source AS p, doc_id, {_PATHS}[doc_id % 7 + 1] AS path, [0, 1, 2, 3, 4, 5, 5][doc_id % 7 + 1] AS place, lang, text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY place, doc_id) AS r FROM c)
SELECT p AS project_id, md5(string_agg('--- File: ' || path || ' (' || lang || ') [file' || CASE WHEN doc_id % 2 = 1 THEN ': n' || doc_id ELSE '' END || '] ---' || chr(10) || coalesce(text, '') || chr(10) || '---', chr(10) || chr(10) ORDER BY r)) AS prompt, FALSE AS summarised FROM r WHERE r <= 50 GROUP BY p"""


@query("documents", sql=_PROMPTS)
def prompt_texts(d):
    """The first 50 chunks of each source, below the budget from which on they are summarised."""
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("doc_id") % 7 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("n"), "doc_id")).otherwise("")
    chunks = d.select(F.col("source").alias("project_id"), F.col("doc_id").alias("seq"), path.alias("path"), F.col("lang").alias("language"), F.lit("file").alias("chunk_type"), name.alias("name"), F.col("text").alias("content"))
    return pages.prompt_texts(chunks, knowledge.Extract(2000), threshold=1 << 40).select("project_id", F.md5("text").alias("prompt"), "summarised")


_FILLED = ["arg_max(c_name, c_custkey) FILTER ({w})", "arg_max(c_mktsegment, c_custkey) FILTER ({w} AND c_custkey % 3 > 0)", "arg_max('o' || c_custkey, c_custkey) FILTER ({w} AND c_custkey % 3 = 0)"]
_CARD = "'Project: ' || p || chr(10) || 'Description: ' || coalesce({d}, '') || chr(10) || 'Keywords: ' || coalesce('kept, ' || {k}, '') || coalesce(chr(10) || 'Owns: ' || {o}, '')"
_REGISTERED = f"""
WITH g AS (SELECT c_nationkey::VARCHAR AS p, count(*) FILTER (c_acctbal >= 0) AS n1, {', '.join(f'{c.format(w=w)} AS {n}{i}' for i, w in ((1, 'c_acctbal >= 0'), (2, 'c_acctbal < 0')) for n, c in zip('dko', _FILLED))} FROM customer GROUP BY 1),
t AS (SELECT p, n1, {_CARD.format(d='d1', k='k1', o='o1')} AS before, {_CARD.format(d='coalesce(d2, d1)', k='coalesce(k2, k1)', o='coalesce(o2, o1)')} AS after FROM g)
SELECT p AS project_id, md5(after) AS card, n1 = 0 OR before <> after AS fresh FROM t"""


@query("customer", sql=_REGISTERED)
def registered_cards(c):
    """Cards of nations after the registrations of customers not in debt, and of
    those in debt; fresh: the second run had to embed the card anew."""
    none = lambda kind: F.lit(None).cast(kind)
    third = F.col("c_custkey") % 3 == 0
    log = c.select(
        F.col("c_nationkey").cast("string").alias("project_id"), F.col("c_name").alias("description"), F.when(third, F.array().cast("array<string>")).otherwise(F.array(F.lit("kept"), "c_mktsegment")).alias("keywords"), none("array<string>").alias("responsibilities"),
        F.when(third, F.array(F.concat(F.lit("o"), "c_custkey"))).alias("owns"), F.lit("").alias("project_type"), none("string").alias("exports"), F.col("c_name").alias("path"), F.col("c_custkey").alias("ts"), (F.col("c_acctbal") < 0).alias("late"),
    )
    spark, embed = c.sparkSession, embedding.hashed_words(16)
    cards = log.limit(0).withColumnRenamed("ts", "last_active")
    first, made = registry.register_projects(cards, log.where("NOT late"), spark.createDataFrame([], embedding.CACHE), "hashed", embed)
    last, fresh = registry.register_projects(first, log.where("late"), made, "hashed", embed)
    new = fresh.select(F.col("chunk_id").alias("project_id"), F.lit(True).alias("fresh"))
    return last.where(F.size("vector") == 16).join(new, "project_id", "left").select("project_id", F.md5("content").alias("card"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


_HITS = f"SELECT *, greatest(0, 1 - d / 2) AS score FROM ({_RANKED}) JOIN documents ON doc_id = vec_id ORDER BY d, vec_id LIMIT {{k}}"


def _searched(e: DataFrame, d: DataFrame, k: int, least: float) -> DataFrame:
    """The index of all documents, searched for the vector of id 0."""
    vector = _first_vector(e)
    index = d.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("file").alias("chunk_type"), F.col("source").alias("name"), F.col("lang").alias("language"), "vector"
    )
    return indexing.search(index, "anything", lambda texts: np.array([vector] * len(texts)), k, least)


@query("embeddings", "documents", sql=f"SELECT 'search' AS event_type, 'anything' AS query, count(*)::BIGINT AS n, array_to_string(list(doc_id::VARCHAR ORDER BY score DESC, doc_id::VARCHAR)[1:5], '|') AS paths, round(max(score), 6) AS best FROM ({_HITS.format(k=10)})")
def search_event(e, d):
    """What the event log holds of a search."""
    event = indexing.search_event(_searched(e, d, 10, 0.0), "p", "s", "a", "anything", F.lit("2024-01-01").cast("timestamp"))
    field = lambda path: F.get_json_object("data", path)
    top = F.from_json(field("$.topResults"), "array<struct<path:string,score:double>>")
    return event.select("event_type", field("$.query").alias("query"), field("$.resultCount").cast("long").alias("n"), F.array_join(F.transform(top, lambda x: x["path"]), "|").alias("paths"), F.round(F.array_max(F.transform(top, lambda x: x["score"])), 6).alias("best"))


@query("embeddings", "documents", sql=f"SELECT doc_id::VARCHAR AS file, 'file' AS type, source AS name, printf('%.2f', score) AS score, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM ({_HITS.format(k=5)})")
def search_snippets(e, d):
    return indexing.search_snippets(_searched(e, d, 5, 0.0))


@query("documents", "labels", sql="SELECT coalesce(quality, -1) AS quality, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS made FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id) GROUP BY 1")
def cache_rounds(d, labels):
    """A cache that was saved twice, loaded, used for all documents, and cleared:
    how many vectors had to be made.  Nothing is left where it was."""
    spark, path, embed = d.sparkSession, shared_folder(d.sparkSession, "cache"), embedding.hashed_words(8)
    chunks = d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    known = chunks.join(labels.select(F.col("doc_id").alias("id")).distinct(), "id")
    _, made = embedding.embed_with_cache(known, embedding.load_cache(spark, path), "hashed", embed)
    for _ in range(2):
        embedding.save_cache(made, path)
    rows, fresh = embedding.embed_with_cache(chunks, embedding.load_cache(spark, path), "hashed", embed)
    quality = labels.select("doc_id", "quality").distinct()
    new = fresh.select(F.col("chunk_id").alias("doc_id"), F.lit(1).alias("new"))
    return rows.select(F.col("id").alias("doc_id")).join(quality, "doc_id", "left").join(new, "doc_id", "left").groupBy(F.coalesce("quality", F.lit(-1)).alias("quality")).agg(count().alias("n"), F.count("new").alias("made"))
