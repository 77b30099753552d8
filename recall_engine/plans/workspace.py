"""Queries of a workspace: what is scanned, matched, delegated and written down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.functions import text as T
from recall_engine.operators import board, coverage, indexing, knowledge, matching, vectors
from recall_engine.plans.boards import _DUPLICATES, _checked_proposals, lock_events
from recall_engine.plans.queries import _COVERAGE, _RANKED, _SIM, file_states
from recall_engine.plans.registered import count, query
from recall_engine.sources import ignore, workspace

_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _paths(p: DataFrame) -> DataFrame:
    return p.select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query("pages", sql=f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), k AS (SELECT page_id, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext, regexp_extract(path, '[^/]*$') AS base FROM p) SELECT page_id, ext IN ('exe', 'pdf', 'jpg', 'png', 'zip', 'db') AS is_binary, ext IN ('html', 'ts', 'js', 'py', 'md', 'json') OR base IN ('Makefile', 'Dockerfile') AS is_code FROM k")
def file_kinds(p):
    path = F.col("path")
    return _paths(p).select("page_id", T.is_binary_file(path).alias("is_binary"), T.is_code_file(path).alias("is_code"))


#: Rules for the paths of the pages: what stays out of a scan.
RULES = "# comments don't count\n*.example.org/\n**/en/*1*.html\n!**/en/*13*.html\n/blog.*/de/**\n"


@query("pages", sql=f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id FROM p WHERE NOT regexp_matches(path, '^[^/]*\\.example\\.org/') AND NOT (regexp_full_match(path, '(.*/)?en/[^/]*1[^/]*\\.html') AND NOT regexp_full_match(path, '(.*/)?en/[^/]*13[^/]*\\.html')) AND NOT regexp_full_match(path, 'blog\\.[^/]*/de/.*')")
def scanned_paths(p):
    """Pages whose paths the rules of an ignore file leave in a scan."""
    return _paths(p).where(~ignore.ignored(F.col("path"), ignore.rules_of(RULES))).select("page_id")


@query("pages", sql=f"WITH p AS (SELECT string_split({_PATH}, '/') AS parts FROM pages), e AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS k FROM p), s AS (SELECT DISTINCT array_to_string(parts[1:k-1], '/') AS folder, parts[k] AS name, k < len(parts) AS is_folder FROM e) SELECT folder, (row_number() OVER (PARTITION BY folder ORDER BY NOT is_folder, lower(name), name) - 1)::INTEGER AS place, name, is_folder FROM s")
def coverage_listing(p):
    """What each folder holds, folders first."""
    return coverage.listed(_paths(p))


@query("documents", "labels", sql=f"WITH c AS ({_COVERAGE}), s AS (SELECT count(*) AS n, count(*) FILTER (indexed AND NOT pending) AS i FROM c) SELECT i AS indexed, n AS total, round(n::DOUBLE / i, 4) AS files_a_indexed FROM s")
def coverage_average(d, labels):
    return coverage.totals(file_states(d, labels)).select("indexed", "total", F.round(F.try_divide("total", "indexed"), 4).alias("files_a_indexed"))


_FOLDERS = "CASE WHEN source < 'src14' THEN source ELSE 'new/' || source END"


@query("documents", "labels", sql=f"WITH c AS (SELECT {_FOLDERS} AS folder, starts_with({_FOLDERS}, 'new/') AS fresh, indexed FROM ({_COVERAGE})) SELECT folder, count(*) AS total FROM c GROUP BY folder HAVING count(*) > 5 AND count(*) FILTER (indexed AND NOT fresh) = 0")
def coverage_gap_folders(d, labels):
    """Folders of more than five files without any in the index: the new ones were never scanned."""
    states = file_states(d, labels)
    folder = F.when(F.col("source") < "src14", F.col("source")).otherwise(F.concat(F.lit("new/"), "source"))
    fresh = states.withColumn("folder", folder).withColumn("status", F.when(F.col("folder").startswith("new/"), coverage.MISSING).otherwise(F.col("status")))
    counts = coverage.by(fresh, "folder").withColumn("indexed", F.col("indexed") + F.col("pending"))
    return coverage.gaps(counts, 5).select("folder", "total")


@query("documents", "labels", sql=f"""
WITH c AS (SELECT *, CASE WHEN lang = 'fr' THEN FALSE ELSE indexed AND NOT pending END AS done, CASE WHEN lang = 'fr' THEN FALSE ELSE pending END AS old FROM ({_COVERAGE})),
t AS (SELECT count(*) AS n, count(*) FILTER (done) AS i, count(*) FILTER (old) AS p, count(*) FILTER (NOT done AND NOT old) AS m FROM c),
l AS (SELECT coalesce(string_agg(lang, ', ' ORDER BY lang), '') AS names FROM (SELECT lang FROM c GROUP BY lang HAVING count(*) FILTER (done) = 0)),
f AS (SELECT coalesce(string_agg(source, ', ' ORDER BY source), '') AS names FROM (SELECT source FROM c GROUP BY source HAVING count(*) FILTER (done) = 0 AND count(*) > 5))
SELECT array_to_string(list_filter([
  CASE WHEN 100.0 * i / n < 50 THEN 'low coverage: ' || printf('%.1f', 100.0 * i / n) || ' %, index the whole project' END,
  CASE WHEN 100.0 * i / n >= 50 AND 100.0 * i / n < 80 THEN 'medium coverage: ' || printf('%.1f', 100.0 * i / n) || ' %, ' || m || ' files aren''t indexed' END,
  CASE WHEN i = n THEN 'complete coverage' END,
  CASE WHEN p > 0 THEN p || ' files changed since they were indexed' END,
  CASE WHEN l.names <> '' THEN 'languages not indexed: ' || l.names END,
  CASE WHEN f.names <> '' THEN 'folders not indexed: ' || f.names END], lambda x: x IS NOT NULL), chr(10)) AS advice FROM t, l, f""")
def coverage_advice(d, labels):
    """The rules that hold when no French file is in the index."""
    states = file_states(d, labels)
    states = states.withColumn("status", F.when(F.col("lang") == "fr", coverage.MISSING).otherwise(F.col("status")))
    found = coverage.advice(coverage.totals(states), coverage.by(states, "lang"), coverage.by(states, "source"))
    return found.select(F.array_join("advice", "\n").alias("advice"))


@query("documents", "events", sql="SELECT count(*) || ' chunk(s) from ' || count(DISTINCT (source, doc_id)) || ' file(s), last indexed ' || (SELECT CASE WHEN m < 60 THEN m || ' minute(s) ago' ELSE m // 60 || ' hour(s) ago' END FROM (SELECT floor(date_diff('millisecond', max(ts), TIMESTAMP '2024-02-01') / 60000)::BIGINT AS m FROM events)) || '. 3 file(s) to index again' AS message FROM documents")
def stats_message(d, e):
    """Statistics of an index in words; its last time is that of the events."""
    last = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    index = d.select(F.col("source").alias("project_id"), F.col("doc_id").alias("file_path"), last.alias("timestamp"))
    return coverage.stats_text(coverage.index_stats(index), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"), 3)


@query("part", sql=f"SELECT p_partkey, coalesce(m.order, -1) AS best, coalesce(round(m.score, 6), 0) AS score FROM (SELECT p_partkey, (SELECT {{'order': b, 'score': s}} FROM (SELECT b.p_partkey AS b, {_SIM.format(a='lower(a.p_name)', b='lower(b.p_name)')} AS s FROM part b WHERE b.p_size % 2 = 1 AND b.p_brand = a.p_brand AND b.p_type = a.p_type) WHERE s >= 0.7 ORDER BY s DESC, b LIMIT 1) AS m FROM part a WHERE a.p_size % 2 = 0)")
def closest_tasks(p):
    """The most similar name of the same brand and type, if 0.7 or more; else -1."""
    got = matching.best_match(p.where("p_size % 2 = 0"), p.where("p_size % 2 = 1"), ["p_brand", "p_type"], "p_name", "p_name", "p_partkey")
    return got.select("p_partkey", F.coalesce("match.order", F.lit(-1)).alias("best"), F.coalesce(F.round("match.score", 6), F.lit(0.0)).alias("score"))


@query("documents", sql="SELECT doc_id FROM documents WHERE contains(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), 'the and') AND contains(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), 'er')")
def all_keywords(d):
    """Documents that hold both keywords."""
    return d.where(T.contains_all(F.col("text"), ["The  AND", "er"])).select("doc_id")


@query("events", sql="WITH a AS (SELECT 'agent' || user_id % 7 || '-' || user_id AS agent_id, max((ts, user_id)) AS seen FROM events GROUP BY user_id), q AS (SELECT DISTINCT 'agent' || user_id % 9 AS name FROM events UNION SELECT min(agent_id) FROM a) SELECT name, coalesce((SELECT agent_id FROM a WHERE a.agent_id = q.name), (SELECT max_by(agent_id, (seen[1], agent_id)) FROM a WHERE starts_with(agent_id, q.name || '-')), name) AS agent_id FROM q")
def resolved_names(e):
    """Names of agents to ids: exact, else the latest that begins with it, else itself."""
    agents = e.groupBy("user_id").agg(F.max("ts").alias("last_seen")).select(F.concat(F.lit("agent"), F.col("user_id") % 7, F.lit("-"), "user_id").alias("agent_id"), "last_seen")
    asked = e.select(F.concat(F.lit("agent"), F.col("user_id") % 9).alias("name")).union(agents.agg(F.min("agent_id"))).distinct()
    return board.resolved_agents(asked, agents)


_CLEAN = """
WITH locks AS (SELECT user_id AS resource, user_id % 20 AS project_id, 'agent' || user_id % 4 AS holder FROM events GROUP BY user_id),
agents AS (SELECT user_id % 20 AS project_id, 'agent' || hour(ts) % 4 AS agent_id, max(ts) AS seen FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT project_id::VARCHAR AS project_id, resource::VARCHAR AS resource, holder AS agent_id, 'release' AS action FROM locks l WHERE NOT EXISTS (
  SELECT 1 FROM agents a WHERE a.project_id = l.project_id AND a.agent_id = l.holder AND a.seen >= TIMESTAMP '2024-01-28')"""


@query("events", sql=_CLEAN)
def lock_cleanup(e):
    """Releases of locks whose holder was not heard of for two days."""
    project, agent = (F.col("user_id") % 20).cast("string"), F.concat(F.lit("agent"), (F.hour("ts") % 4).cast("string"))
    locks = e.select(project.alias("project_id"), F.col("user_id").cast("string").alias("resource"), F.concat(F.lit("agent"), F.col("user_id") % 4).alias("holder")).distinct()
    agents = e.where("event_type = 'signup'").groupBy(project.alias("project_id"), agent.alias("agent_id")).agg(F.max("ts").alias("last_seen"))
    return board.cleanup_events(locks, agents, F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"), 2 * 24 * 60)


@query("events", "customer", sql="SELECT project_id, agent_id, c_name, c_mktsegment FROM (SELECT (user_id % 20)::VARCHAR AS project_id, arg_max('agent' || hour(ts) % 4, (ts, event_id)) AS agent_id FROM events WHERE event_type = 'signup' GROUP BY 1) LEFT JOIN customer ON c_custkey::VARCHAR = project_id")
def agent_cards(e, c):
    """Active agents with the metadata of their project's card."""
    cards = c.select(F.col("c_custkey").cast("string").alias("project_id"), "c_name", "c_mktsegment")
    return board.with_cards(board.active_agents(lock_events(e.where("event_type = 'signup'"))).select("project_id", "agent_id"), cards, ["c_name", "c_mktsegment"])


@query("events", sql="SELECT user_id AS session_id, arg_max('agent' || hour(ts) % 4, (ts, event_id)) AS agent_id FROM events GROUP BY user_id")
def session_agents(e):
    """The agent of each session: the one that registered last."""
    log = lock_events(e).select(F.col("resource").cast("long").alias("project_id"), "agent_id", "ts", "seq")
    return board.active_agents(log).select(F.col("project_id").alias("session_id"), "agent_id")


@query("part", sql=f"""SELECT p.p_partkey AS proposal_id, coalesce(t.task, -1) AS task_id, t.task IS NOT NULL AS is_duplicate, CASE WHEN t.task IS NULL THEN 'PENDING' WHEN b.p_size % 3 = 0 THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status,
  CASE WHEN t.task IS NULL THEN md5(p.p_type || chr(10) || chr(10) || 'Context:' || chr(10) || p.p_brand) END AS description
FROM (SELECT * FROM part WHERE p_size % 2 = 0) p LEFT JOIN (SELECT a.p_partkey, max(b.p_partkey) AS task FROM part a JOIN part b ON a.p_brand = b.p_brand
  WHERE a.p_size % 2 = 0 AND b.p_size % 2 = 1 AND {_SIM.format(a='lower(a.p_name)', b='lower(b.p_name)')} >= 0.85 GROUP BY 1) t ON p.p_partkey = t.p_partkey LEFT JOIN part b ON b.p_partkey = t.task""")
def delegated_tasks(p):
    """Proposals created as tasks, or the task that is there already."""
    proposals = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("proposal_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_brand").alias("context"))
    tasks = p.where("p_size % 2 = 1").select(F.col("p_brand").alias("project_id"), F.col("p_partkey").alias("task_id"), F.col("p_partkey").alias("created_at"), F.when(F.col("p_size") % 3 == 0, "COMPLETED").otherwise("IN_PROGRESS").alias("status"), F.col("p_name").alias("title"))
    return board.delegated(proposals, tasks).select("proposal_id", F.coalesce("task_id", F.lit(-1)).alias("task_id"), "is_duplicate", "status", F.md5("description").alias("description"))


@query("part", sql=f"SELECT p_brand AS project_id, count(*) FILTER (duplicate_of < 0) AS valid, count(*) FILTER (duplicate_of >= 0) AS duplicates, CASE WHEN count(*) FILTER (duplicate_of < 0) = 0 THEN 'proceed' WHEN count(*) FILTER (p_size > 40) > 0 THEN 'mixed' ELSE 'delegate' END AS action FROM ({_DUPLICATES}) JOIN part ON p_partkey = proposal_id GROUP BY 1")
def route_mixed(p):
    """Actions where a project keeps its large parts for itself."""
    own = p.where("p_size % 2 = 0").groupBy(F.col("p_brand").alias("project_id")).agg(F.count_if(F.col("p_size") > 40).alias("responsibilities"))
    return board.routing_decision(_checked_proposals(p), "project_id", own)


_ENTRY = "'### ' || strftime(o_orderdate, '%Y-%m-%d') || ' - 📌 Order ' || o_orderkey || chr(10) || chr(10) || '**Decision**: ' || o_orderpriority || chr(10) || chr(10) || '**Rationale**: ' || o_orderstatus || chr(10) || CASE WHEN o_orderstatus = 'F' THEN chr(10) || '**Impact**: done' || chr(10) ELSE '' END || chr(10) || '---' || chr(10)"


@query("orders", sql=f"SELECT o_custkey, count(*) AS decisions, md5('# Log' || chr(10) || '## Decisions' || chr(10) || string_agg(chr(10) || {_ENTRY}, '' ORDER BY o_orderkey DESC)) AS text FROM orders GROUP BY o_custkey")
def decision_log(o):
    """The decisions of each customer written to a log one by one, the newest on top, and counted in it."""
    none = F.lit("")
    entry = knowledge.decision_entry(F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("Order "), "o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.array().cast("array<string>"), F.when(F.col("o_orderstatus") == "F", "done").otherwise(none), none)
    entries = F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e"))))
    logs = o.groupBy("o_custkey").agg(F.aggregate(F.transform(entries, lambda x: x["e"]), F.lit("# Log\n## Decisions\n"), lambda log, e: knowledge.with_entry(log, e)).alias("text"))
    return logs.select("o_custkey", knowledge.decision_count(F.col("text")).alias("decisions"), F.md5("text").alias("text"))


_ROW = "'| ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || o_orderstatus || ' | Order ' || o_orderkey || ' | ' || o_orderpriority || ' |'"


@query("orders", sql=f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders),
h AS (SELECT o_custkey, string_agg({_ROW}, chr(10) ORDER BY k) AS history FROM r WHERE k <= 10 GROUP BY o_custkey)
SELECT o_custkey, md5('# Active Context' || chr(10) || chr(10) || '## Current Session' || chr(10) || '- **Date**: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || '- **Mode**: ' || o_orderstatus || chr(10) || '- **Current Task**: Order ' || o_orderkey
  || chr(10) || chr(10) || '## Session History' || chr(10) || '| Date | Mode | Task | Notes |' || chr(10) || '|------|------|------|-------|' || chr(10) || history
  || chr(10) || chr(10) || '## Recent Changes' || chr(10) || '- ' || o_orderpriority || chr(10) || chr(10) || '## Open Questions' || chr(10) || '- No open questions' || chr(10) || chr(10) || '## Next Steps' || chr(10) || '- [ ] Continue development'
  || chr(10) || chr(10) || '## Active Considerations' || chr(10) || o_orderpriority || chr(10)) AS text FROM r JOIN h USING (o_custkey) WHERE k = 1""")
def active_contexts(o):
    """The active context of each customer: the latest order is the session at hand."""
    rows = o.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("mode"), F.concat(F.lit("Order "), "o_orderkey").alias("task"), F.col("o_orderpriority").alias("notes"), F.col("o_orderkey").alias("seq"))
    last = rows.groupBy("o_custkey").agg(F.max("seq").alias("last"))
    each = rows.join(last, "o_custkey")
    none = F.array().cast("array<string>")
    session = each.where("seq = last").select("o_custkey", "date", "mode", "task", F.array("notes").alias("changes"), none.alias("questions"), none.alias("steps"), "notes")
    found = knowledge.active_context(session, each.where("seq < last").drop("last"), "o_custkey")
    return found.select("o_custkey", F.md5("text").alias("text"))


@query("pages", sql=f"WITH p AS (SELECT {_PATH} AS path FROM pages), f AS (SELECT string_split(path, '/')[1] AS host, lower(string_split(path, '/')[-1]) AS name FROM p) SELECT host, 'activeContext,progress' || CASE WHEN count(*) FILTER (regexp_matches(name, '^(package\\.json|tsconfig\\.json|dockerfile|makefile|pyproject\\.toml|cargo\\.toml|go\\.mod)$|config')) > 0 THEN ',techContext' ELSE '' END || CASE WHEN count(*) FILTER (regexp_matches(name, '^(index|main|app|readme)\\b')) > 0 THEN ',projectBrief' ELSE '' END || CASE WHEN count(*) > 5 THEN ',systemPatterns,productContext' ELSE '' END AS documents FROM f GROUP BY host")
def outdated_documents(p):
    """Documents that changed paths of each host make out of date."""
    paths = _paths(p).select(F.substring_index("path", "/", 1).alias("host"), "path")
    return knowledge.documents_to_update(paths, "host").select("host", F.array_join("documents", ",").alias("documents"))


@query("documents", "events", "labels", sql="WITH s AS (SELECT source AS project_id, 'index' AS source FROM documents UNION SELECT event_type, 'board' FROM events UNION SELECT source, 'registry' FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT project_id, bool_or(source = 'registry') AS known, string_agg(source, ',' ORDER BY source) AS sources FROM s WHERE project_id <> '' GROUP BY project_id")
def synced_projects(d, e, labels):
    """Every project that the registry, the index or the boards know."""
    cards = d.join(labels.where("quality = 1"), "doc_id").select(F.col("source").alias("project_id"))
    index = d.select(F.col("source").alias("project_id"), F.lit("index").alias("source"))
    boards = e.select(F.col("event_type").alias("project_id"), F.lit("board").alias("source"))
    return workspace.synchronised(cards, index, boards).select("project_id", "known", F.array_join("sources", ",").alias("sources"))


@query("supplier", sql="SELECT s_suppkey AS project_id, name, md5('# ' || name || ': ' || s_name || chr(10) || chr(10) || '*Begun: 2024-01-01*' || chr(10) || body) AS text FROM supplier, (VALUES ('decisionLog', chr(10) || '## Decisions' || chr(10) || chr(10)), ('projectBrief', chr(10) || '## Goals' || chr(10) || chr(10) || chr(10) || '## Scope' || chr(10) || chr(10))) t(name, body)")
def first_documents(s):
    """Two of the documents that each project begins with."""
    rows = s.select(F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("title"), F.lit("2024-01-01").alias("date"))
    return workspace.initial_documents(rows).where(F.col("name").isin("decisionLog", "projectBrief")).select("project_id", "name", F.md5("text").alias("text"))


@query("supplier", "nation", sql="SELECT s_suppkey, coalesce('brief of ' || n_name, 'No document brief of project ' || s_suppkey) AS text FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey")
def document_lookup(s, n):
    """The brief of each project by its short name, or a message."""
    held = n.select(F.col("n_nationkey").cast("string").alias("project_id"), F.lit("Project_Brief.md").alias("name"), F.concat(F.lit("brief of "), "n_name").alias("text"))
    asked = s.select("s_suppkey", F.col("s_suppkey").cast("string").alias("project_id"), F.lit("brief").alias("name"))
    return workspace.asked_documents(asked, held).select("s_suppkey", "text")


@query("embeddings", sql="SELECT label, printf('%.3f', avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS average FROM embeddings GROUP BY label")
def average_scores(e):
    """Scores in three decimals, as a search reports them."""
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return e.groupBy("label").agg(F.format_string("%.3f", F.avg(size)).alias("average"))


@query("events", sql="SELECT event_id, 'EXT-' || right(lpad(epoch_ms(ts)::VARCHAR, 6, '0'), 6) AS id FROM events")
def task_ids(e):
    """The first six digits, as the SQL has them (lpad cuts from the right);
    task_numbers has the ids of tasks."""
    return e.select("event_id", F.concat(F.lit("EXT-"), F.lpad(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), 6, "0")).alias("id"))


@query("events", sql="SELECT event_id, 'EXT-' || right('00000' || (epoch_us(ts) // 1000)::VARCHAR, 6) AS id FROM events")
def task_numbers(e):
    return e.select("event_id", T.task_id(F.col("ts"), True).alias("id"))


@query("events", sql="SELECT (user_id % 20)::VARCHAR AS project_id, count(*) AS n FROM events GROUP BY 1")
def board_events(e):
    return lock_events(e).groupBy("project_id").agg(count().alias("n"))


_DOT = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"


@query("embeddings", sql=f"SELECT vec_id, round(c, 6) AS score FROM (SELECT e.vec_id, {_DOT} / sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS c FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q) ORDER BY c DESC, vec_id LIMIT 7")
def cosine_topk(e):
    query = e.where("vec_id = 1").select("embedding").first()[0]
    return vectors.top_k(e, query, 7, metric="cosine").select("vec_id", F.round("score", 6).alias("score"))


@query("embeddings", sql=f"SELECT 'Found ' || count(*) || ' result(s), average score ' || printf('%.3f', avg(greatest(0, 1 - d / 2))) AS message FROM (SELECT * FROM ({_RANKED}) ORDER BY d, vec_id LIMIT 10)")
def search_summary(e):
    query = e.where("vec_id = 0").select("embedding").first()[0]
    return indexing.search_message(vectors.top_k(e, query, 10))


@query("documents", "labels", sql="SELECT state, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'generated' WHEN l.quality = 1 THEN 'skipped' ELSE 'updated' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY state")
def generated_documents(d, labels):
    """Documents written anew, brought up to date and left as they are."""
    wanted = d.select(F.col("doc_id").alias("project_id"), F.lit("brief").alias("type"), F.md5("text").alias("fingerprint"), F.col("lang").alias("prompt"))
    stored = d.join(labels, "doc_id").select(F.col("doc_id").alias("project_id"), F.lit("brief").alias("type"), F.when(F.col("quality") == 1, F.md5("text")).otherwise("old").alias("fingerprint"))
    return knowledge.generate_documents(wanted, stored, str.upper).groupBy("state").agg(count().alias("n"))
