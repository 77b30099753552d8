"""Named queries over the driver's tables, each with its SQL counterpart.

Tables play these parts: documents are indexed files (source: project, lang:
language), labels the index's record of them, embeddings chunk vectors, events
the session log, orders tasks of customers' boards, parts and suppliers
registry cards, pages files with paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions import text as T
from recall_engine.operators import chunking, coverage, digests, knowledge, matching, vectors
from recall_engine.plans.registered import count, query
from recall_engine.streaming.events import session_counts

_DISTANCE = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"
_RANKED = f"SELECT e.vec_id, e.label, {_DISTANCE} AS d FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _first_vector(e: DataFrame) -> list[float]:
    return e.where("vec_id = 0").select("embedding").first()[0]


@query("embeddings", sql=f"SELECT vec_id, round(d, 6) AS distance, round(greatest(0, 1 - d / 2), 6) AS score FROM (SELECT * FROM ({_RANKED}) ORDER BY d, vec_id LIMIT 10) WHERE greatest(0, 1 - d / 2) >= 0.3")
def vector_topk(e):
    return vectors.top_k(e, _first_vector(e), 10, 0.3).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query("embeddings", sql=f"SELECT vec_id, label, round(greatest(0, 1 - d / 2), 6) AS score FROM ({_RANKED}) WHERE label = 3 ORDER BY d, vec_id LIMIT 10")
def vector_topk_filtered(e):
    return vectors.top_k(e, _first_vector(e), 10, where=F.col("label") == 3).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("embeddings", sql=f"SELECT vec_id, round(1 - d, 6) AS score FROM (SELECT * FROM ({_RANKED}) ORDER BY d, vec_id LIMIT 10)")
def project_score(e):
    return vectors.top_k(e, _first_vector(e), 10).select("vec_id", F.round(1 - F.col("distance"), 6).alias("score"))


@query("embeddings", sql=f"WITH q AS (SELECT label, vec_id, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) SELECT label, query_id, vec_id, rank::INTEGER AS rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT q.label, q.vec_id AS query_id, e.vec_id, {_DISTANCE} AS d FROM embeddings e JOIN q USING (label))) WHERE rank <= 5")
def multi_query_topk(e):
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    return vectors.top_k_each(e, first, "label", 5).select("label", "query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query("documents", sql="SELECT count(*) AS chunks, count(DISTINCT doc_id) AS files, count(DISTINCT source) AS projects, max(n_chars) AS largest FROM documents")
def index_stats(d):
    return d.agg(count().alias("chunks"), F.countDistinct("doc_id").alias("files"), F.countDistinct("source").alias("projects"), F.max("n_chars").alias("largest"))


@query("documents", sql="SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lang_counts(d):
    return d.groupBy("lang").agg(count().alias("n"))


@query("events", sql="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_counts(e):
    return e.groupBy("event_type").agg(count().alias("n"))


@query("documents", sql="SELECT DISTINCT source FROM documents WHERE source <> ''")
def distinct_projects(d):
    return d.where(F.col("source") != "").select("source").distinct()


@query("documents", sql="SELECT source, count(*) AS chunks, max(n_chars) AS largest, min_by(sha256(text), doc_id) AS first_hash FROM documents GROUP BY source")
def file_rollup(d):
    return d.groupBy("source").agg(count().alias("chunks"), F.max("n_chars").alias("largest"), F.min_by(F.sha2("text", 256), "doc_id").alias("first_hash"))


_COVERAGE = "SELECT d.*, l.doc_id IS NOT NULL AS indexed, coalesce(l.quality, 1) = 0 AS pending FROM documents d LEFT JOIN labels l USING (doc_id)"


def file_states(d: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their status: labels are the index, out of date where the quality is 0."""
    index = labels.select("doc_id", F.when(F.col("quality") == 0, "old").otherwise("new").alias("hash"), F.lit(1).alias("chunks"))
    return coverage.file_status(d.withColumn("hash", F.lit("new")), index, on="doc_id")


@query("documents", "labels", sql=f"SELECT count(*) AS total, count(*) FILTER (indexed AND NOT pending) AS indexed, count(*) FILTER (pending) AS pending, count(*) FILTER (NOT indexed) AS missing, sum(n_chars)::BIGINT AS size, round(100.0 * count(*) FILTER (indexed AND NOT pending) / count(*), 4)::DOUBLE AS percent FROM ({_COVERAGE})")
def coverage_totals(d, labels):
    return coverage.totals(file_states(d, labels), "n_chars").select("total", "indexed", "pending", "missing", "size", F.round("percent", 4).alias("percent"))


@query("documents", "labels", sql=f"SELECT lang, count(*) AS total, count(*) FILTER (indexed) AS indexed FROM ({_COVERAGE}) GROUP BY lang")
def coverage_by_lang(d, labels):
    return coverage.by(file_states(d, labels), "lang").select("lang", "total", (F.col("indexed") + F.col("pending")).alias("indexed"))


@query("documents", "labels", sql=f"SELECT source, count(*) AS total, count(*) FILTER (indexed) AS indexed, count(*) FILTER (pending) AS pending FROM ({_COVERAGE}) GROUP BY source")
def coverage_by_dir(d, labels):
    return coverage.by(file_states(d, labels), "source").select("source", "total", (F.col("indexed") + F.col("pending")).alias("indexed"), "pending")


@query("documents", "labels", sql=f"SELECT lang, CASE WHEN 100 * i < 50 * n THEN 'low' WHEN 100 * i < 80 * n THEN 'medium' WHEN i = n THEN 'full' ELSE 'good' END AS coverage, p > 0 AS reindex FROM (SELECT lang, count(*) AS n, count(*) FILTER (indexed AND NOT pending) AS i, count(*) FILTER (pending) AS p FROM ({_COVERAGE}) GROUP BY lang)")
def coverage_rules(d, labels):
    c = coverage.by(file_states(d, labels), "lang")
    return c.select("lang", F.expr("CASE WHEN 100 * indexed < 50 * total THEN 'low' WHEN 100 * indexed < 80 * total THEN 'medium' WHEN indexed = total THEN 'full' ELSE 'good' END").alias("coverage"), (F.col("pending") > 0).alias("reindex"))


@query("pages", sql="WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts, strlen(html) AS size FROM pages) SELECT array_to_string(parts[1:k], '/') AS folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM p, unnest(range(1, len(parts))) AS t(k) GROUP BY 1")
def coverage_tree(p):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = p.select(path.alias("path"), F.octet_length("html").alias("bytes"), F.lit(coverage.INDEXED).alias("status"), F.lit(1).cast("long").alias("chunks"))
    return coverage.tree(rows, size="bytes").select("folder", F.col("total").alias("files"), F.col("size").alias("bytes"))


_OLD = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS old_hash FROM documents WHERE doc_id % 5 <> 0"


@query("documents", sql=f"SELECT d.doc_id, o.old_hash IS NULL AS is_new FROM documents d LEFT JOIN ({_OLD}) o USING (doc_id) WHERE o.old_hash IS NULL OR o.old_hash <> md5(d.text)")
def changed_files(d):
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.expr("CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END").alias("old_hash"))
    now = d.select("doc_id", F.md5("text").alias("hash"))
    return now.join(old, "doc_id", "left").where("old_hash IS NULL OR old_hash <> hash").select("doc_id", F.col("old_hash").isNull().alias("is_new"))


@query("documents", sql="SELECT doc_id, substr(sha256(concat_ws(':', source, '1', text)), 1, 16) AS id, sha256(text) AS hash FROM documents")
def chunk_ids(d):
    return d.select("doc_id", T.chunk_id(F.col("source"), F.lit(1), F.col("text")).alias("id"), F.sha2("text", 256).alias("hash"))


@query("documents", sql="SELECT source, md5(string_agg(x, '|' ORDER BY x)) AS fingerprint FROM (SELECT source, doc_id || ':' || md5(text) AS x FROM documents) GROUP BY source")
def project_fingerprint(d):
    return d.select("source", F.concat_ws(":", "doc_id", F.md5("text")).alias("x")).groupBy("source").agg(F.md5(F.array_join(F.sort_array(F.collect_list("x")), "|")).alias("fingerprint"))


_LANES = "count(*) || ':' || sum(('0x' || substr(md5(x), 1, 16))::UBIGINT) || ':' || sum(('0x' || substr(md5(x), 17, 16))::UBIGINT)"


@query("documents", sql=f"SELECT source, {_LANES} AS digest FROM (SELECT source, doc_id || ':' || md5(text) AS x FROM documents) GROUP BY source")
def project_digest(d):
    return digests.set_digest(d, ["source"], F.concat_ws(":", "doc_id", F.md5("text"))).select("source", digests.digest_text().alias("digest"))


@query("documents", "labels", sql=f"SELECT source, {_LANES} AS digest FROM (SELECT source, doc_id || ':' || md5(CASE WHEN quality = 0 THEN text || '!' ELSE text END) AS x FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source")
def project_digest_update(d, labels):
    """The digest after the documents of quality 0 changed, from the one before
    and the changed documents alone."""
    item = lambda text: F.concat_ws(":", "doc_id", F.md5(text))
    changed = d.join(labels.where("quality = 0").select("doc_id"), "doc_id")
    before, went = digests.set_digest(d, ["source"], item(F.col("text"))), digests.set_digest(changed, ["source"], item(F.col("text")))
    came = digests.set_digest(changed, ["source"], item(F.concat("text", F.lit("!"))))
    return digests.updated_digest(before, ["source"], came, went).select("source", digests.digest_text().alias("digest"))


_SIM = "1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))"


@query("part", sql=f"SELECT p_partkey, match FROM (SELECT a.p_partkey, b.p_partkey AS match, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey DESC) AS r FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND b.p_partkey < a.p_partkey WHERE {_SIM.format(a='lower(trim(a.p_name))', b='lower(trim(b.p_name))')} >= 0.85) WHERE r = 1")
def fuzzy_dedup(p):
    """The latest earlier part of the same brand and type (the project) with nearly the same name."""
    a = p.select("p_partkey", "p_brand", "p_type", F.col("p_name").alias("name"))
    pairs = matching.fuzzy_pairs(a, a.withColumnRenamed("p_partkey", "match"), ["p_brand", "p_type"], ["name"], [0.85])
    return pairs.where(F.col("match") < F.col("p_partkey")).groupBy("p_partkey").agg(F.max("match").alias("match"))


@query("supplier", "nation", sql=f"SELECT n_nationkey, s_suppkey, score FROM (SELECT n.n_nationkey, s.s_suppkey, round({_SIM.format(a='lower(n.n_name)', b='lower(s.s_name)')}, 6) AS score, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY {_SIM.format(a='lower(n.n_name)', b='lower(s.s_name)')} DESC, s.s_suppkey) AS r FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey) WHERE r = 1")
def best_match(s, n):
    rows = n.join(s, n["n_nationkey"] == s["s_nationkey"]).withColumn("score", T.text_similarity(F.col("n_name"), F.col("s_name")))
    best = Window.partitionBy("n_nationkey").orderBy(F.desc("score"), "s_suppkey")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").select("n_nationkey", "s_suppkey", F.round("score", 6).alias("score"))


@query("documents", sql="SELECT doc_id, md5(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS normal FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*', 's')")
def normalize_text(d):
    return d.where(F.col("text").rlike("^[\\x00-\\x7F]*$")).select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normal"))


@query("documents")
def normalize_text_all(d):
    """Every document, those with other characters than ASCII and null texts too."""
    return d.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normal"))


@query("pages", sql="SELECT page_id, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS base, lower(regexp_extract(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '[^/]\\.([^./]+)$', 1)) AS ext FROM pages")
def path_parts(p):
    base = F.regexp_extract("url", "([^/?#]*)([?#].*)?$", 1)
    return p.select("page_id", base.alias("base"), T.extension(base).alias("ext"))


@query("supplier", sql="SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM supplier")
def project_slug(s):
    return s.select("s_suppkey", T.slug(F.col("s_name")).alias("slug"))


@query("documents", sql="SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY source")
def token_counts(d):
    return d.groupBy("source").agg(F.sum(T.token_count(F.col("text"))).alias("tokens"))


@query("documents", sql="SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents")
def line_slice(d):
    return d.select("doc_id", T.line_slice(F.col("text"), 2, 4).alias("lines"))


@query("documents", sql="SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[2:6], chr(10)) AS preview FROM documents")
def preview(d):
    return d.select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("documents")
def line_chunks(d):
    return chunking.line_chunks(d, 300, 40, "doc_id", "text").select("file_path", "start_line", "end_line", "token_count", "id")


@query("conversations")
def bin_pack(c):
    rows = c.withColumn("cost", T.token_count(F.col("text")) + 20)
    return chunking.greedy_batches(rows, 400, "conv_id", "turn", "cost")


@query("events", sql="SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id")
def session_summary(e):
    return e.groupBy("user_id").agg(count().alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("events", sql="SELECT event_type, event_id, r::INTEGER AS r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def events_by_type_last_n(e):
    last = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("r", F.row_number().over(last)).where("r <= 20").select("event_type", "event_id", "r")


@query("events", sql="SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_events(e):
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


@query("events", sql="SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY event_type")
def retention(e):
    return e.where("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").groupBy("event_type").agg(count().alias("n"))


@query("events", sql="SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def session_windows(e):
    return session_counts(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("orders", sql="SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey")
def latest_state(o):
    return o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query("events", sql="SELECT user_id, min_by(event_id, (ts, event_id)) AS claim FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_claim(e):
    return e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("claim"))


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphan_locks(c, o):
    active = o.where("o_orderstatus = 'P'")
    return c.join(active, c["c_custkey"] == active["o_custkey"], "left_anti").select("c_custkey")


@query("orders", sql="SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY o_custkey")
def open_tasks(o):
    return o.where(F.col("o_orderstatus").isin("O", "P")).groupBy("o_custkey").agg(count().alias("n"))


@query("part", sql="SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_type), 'e')")
def keyword_filter(p):
    return p.where(F.lower("p_name").contains("a") & F.lower("p_type").contains("e")).select("p_partkey")


@query("supplier", "nation", sql="SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '7') OR contains(lower(n_name), '7')")
def discover_text(s, n):
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).where(F.lower("s_name").contains("7") | F.lower("n_name").contains("7")).select("s_suppkey")


@query("customer", sql="SELECT c_mktsegment, max_by(c_name, c_custkey) AS latest FROM customer WHERE starts_with(c_name, 'Customer') GROUP BY c_mktsegment")
def prefix_resolve(c):
    return c.where(F.col("c_name").startswith("Customer")).groupBy("c_mktsegment").agg(F.max_by("c_name", "c_custkey").alias("latest"))


@query("documents", "events", sql="SELECT source AS project FROM documents UNION SELECT event_type FROM events")
def union_projects(d, e):
    return d.select(F.col("source").alias("project")).union(e.select("event_type")).distinct()


@query("documents", "labels", sql="SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def skipped_docs(d, labels):
    return d.select("doc_id").subtract(labels.select("doc_id"))


@query("part", sql="SELECT lower(p_type) AS kind, min(p_partkey) AS first FROM part GROUP BY 1")
def merge_ci(p):
    return p.groupBy(F.lower("p_type").alias("kind")).agg(F.min("p_partkey").alias("first"))


@query("pages", sql="SELECT page_id FROM pages ORDER BY CASE WHEN contains(lower(url), 'readme') THEN 1 WHEN contains(lower(url), 'index') THEN 2 WHEN contains(lower(url), 'main') THEN 3 WHEN contains(lower(url), 'app') THEN 4 ELSE 9 END, page_id LIMIT 50")
def priority_sort(p):
    return p.orderBy(knowledge.entry_rank(F.col("url")), "page_id").limit(50).select("page_id")


@query("conversations", sql="SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t FROM conversations) WHERE t <= 300")
def budget_prefix(c):
    run = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("t", F.sum(T.token_count(F.col("text"))).over(run)).where("t <= 300").select("conv_id", "turn")


@query("events", sql="SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_extract(e):
    return e.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(count().alias("n"))


@query("pages", sql="SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, bool_or(contains(url, '.html')) AS has_html, count(*) > 5 AS many FROM pages GROUP BY 1")
def doc_selection(p):
    return p.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host")).agg(F.bool_or(F.col("url").contains(".html")).alias("has_html"), (count() > 5).alias("many"))


@query("conversations", sql="SELECT role, round(sum(ceil(length(text) / 4.0)) * 0.003 / 1000, 6)::DOUBLE AS cost FROM conversations GROUP BY role")
def cost_estimate(c):
    return c.groupBy("role").agg(F.round(F.sum(T.token_count(F.col("text"))) * F.lit(0.003) / 1000, 6).alias("cost"))


@query("documents", "labels", sql="SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1")
def cache_split(d, labels):
    return d.join(labels.where("quality = 1").select("doc_id", F.lit(True).alias("known")), "doc_id", "left").select("doc_id", F.col("known").isNotNull().alias("hit"))
