"""Queries of the index and of project documents.

Orders stand for a customer's tasks: status F is done, O in progress, P pending.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_engine.functions import text as T
from recall_engine.operators import code_chunks as C
from recall_engine.operators import coverage, embedding, indexing, knowledge, retention, store
from recall_engine.operators.ranges import shared_folder
from recall_engine.plans.queries import _COVERAGE, file_states
from recall_engine.plans.registered import count, query

_RENDERED = "SELECT o_custkey, string_agg(CASE WHEN o_orderstatus = 'F' THEN '- [x] ' ELSE '- [ ] ' END || 'Order ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey"


def _rendered(o: DataFrame) -> DataFrame:
    rows = o.select("o_custkey", "o_orderkey", F.concat(F.lit("Order "), "o_orderkey").alias("title"), (F.col("o_orderstatus") == "F").alias("done"))
    return knowledge.render_checklist(rows, "o_custkey", "title", "done", "o_orderkey")


@query("orders", sql=f"SELECT o_custkey, md5(text) AS text FROM ({_RENDERED})")
def progress_render(o):
    return _rendered(o).select("o_custkey", F.md5("text").alias("text"))


@query("orders", sql="SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY o_custkey")
def progress_parse(o):
    """Counts of the items parsed from the rendered lists."""
    return _rendered(o).select("o_custkey", F.size(knowledge.checklist(F.col("text"), True)).cast("long").alias("done"), F.size(knowledge.checklist(F.col("text"), False)).cast("long").alias("open"))


@query("orders", sql="SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = o.o_custkey AND f.o_orderstatus = 'F' AND lower(f.o_orderpriority) = lower(o.o_orderpriority))")
def moved_tasks(o):
    open_, done = o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'")
    return knowledge.still_open(open_, done, "o_custkey", "o_orderpriority").select("o_custkey", "o_orderpriority").distinct()


@query("orders", sql="SELECT o_custkey, lower(o_orderpriority) AS title, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 0 ELSE 1 END AS side FROM orders GROUP BY 1, 2")
def merge_progress(o):
    kept, new = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")
    merged = knowledge.merge_titles(kept, new, "o_custkey", "o_orderpriority", "o_orderkey")
    return merged.select("o_custkey", F.lower("o_orderpriority").alias("title"), "side")


@query("orders", sql="SELECT o_custkey, o_orderkey, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 10")
def session_history(o):
    return knowledge.recent_history(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "place")


@query("events", sql="SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_in_text(e):
    told = F.concat(F.lit("The answer is "), "props", F.lit(" as asked."))
    return e.groupBy(F.get_json_object(knowledge.json_object(told), "$.k").cast("long").alias("k")).agg(count().alias("n"))


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '🔴' WHEN o_orderpriority = '3-MEDIUM' THEN '🟡' WHEN o_orderpriority = '5-LOW' THEN '🟢' ELSE '⚪' END AS mark FROM orders")
def severity_marks(o):
    word = F.when(F.col("o_orderpriority") == "1-URGENT", "High").otherwise(F.regexp_extract("o_orderpriority", r"-(.*)$", 1))
    return o.select("o_orderkey", knowledge.mark_of(word, knowledge.SEVERITY_MARKS, "⚪").alias("mark"))


@query("documents", sql="WITH w AS (SELECT source AS project_id, md5(string_agg(x, '|' ORDER BY x)) AS fingerprint FROM (SELECT source, doc_id || ':' || md5(text) AS x FROM documents) GROUP BY source) SELECT project_id, fingerprint FROM w WHERE NOT starts_with(fingerprint, 'a')")
def documents_to_generate(d):
    """Documents whose fingerprint differs from the stored one (those that begin with a are stored)."""
    from recall_engine.plans.queries import project_fingerprint

    wanted = project_fingerprint(d).select(F.col("source").alias("project_id"), F.lit("brief").alias("type"), "fingerprint")
    return knowledge.to_generate(wanted, wanted.where(F.col("fingerprint").startswith("a"))).select("project_id", "fingerprint")


@query("conversations", sql="SELECT conv_id, turn, md5('Role: ' || role || chr(10) || 'Text: ' || text) AS prompt FROM conversations")
def prompts(c):
    return c.select("conv_id", "turn", F.md5(knowledge.render_prompt("Role: {{role}}\nText: {{text}}", {"role": F.col("role"), "text": F.col("text")})).alias("prompt"))


@query("documents")
def summaries(d):
    """Chunks of each source, summarised until they fit a prompt of 20,000 tokens."""
    rows = d.select(F.col("source").alias("project_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    out = knowledge.summarise_to_budget(rows, knowledge.Extract(2000), threshold=20_000, most=10_000)
    return out.select("project_id", "seq", F.length("content").alias("n_chars"))


@query("documents", sql="SELECT k.lang, count(doc_id) AS n, coalesce(sum(ceil(length(text) / 4.0)), 0)::BIGINT AS tokens, coalesce(max(doc_id), -1) AS last FROM (VALUES ('de'), ('en'), ('fr'), ('xx')) k(lang) LEFT JOIN documents d ON d.lang = k.lang GROUP BY k.lang")
def doc_stats(d):
    """Counts of each expected kind, those without documents too."""
    kinds = d.sparkSession.createDataFrame([(x,) for x in ("de", "en", "fr", "xx")], "lang string")
    found = d.groupBy("lang").agg(count().alias("n"), F.sum(T.token_count(F.col("text"))).alias("tokens"), F.max("doc_id").alias("last"))
    return kinds.join(found, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("last", F.lit(-1)).alias("last"))


@query("documents", "labels", sql=f"SELECT source FROM ({_COVERAGE}) GROUP BY source HAVING count(*) > 5 AND count(*) FILTER (indexed) = 0")
def coverage_gaps(d, labels):
    """Projects of more than five files of which the index knows none."""
    counts = coverage.by(file_states(d, labels), "source")
    return coverage.gaps(counts.withColumn("indexed", F.col("indexed") + F.col("pending")), 5).select("source")


@query("documents", "labels", sql="SELECT doc_id, md5(text) AS hash, FALSE AS fresh FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, md5(text || '!') AS hash, TRUE FROM documents JOIN labels USING (doc_id)")
def replace_chunks(d, labels):
    """An index whose labelled files were written anew."""
    index = d.select(F.lit("p").alias("project_id"), F.col("doc_id").alias("file_path"), F.md5("text").alias("hash"), F.lit(False).alias("fresh"))
    rows = d.join(labels.select("doc_id"), "doc_id").select(F.lit("p").alias("project_id"), F.col("doc_id").alias("file_path"), F.md5(F.concat("text", F.lit("!"))).alias("hash"), F.lit(True).alias("fresh"))
    return indexing.replace_files(index, rows).select(F.col("file_path").alias("doc_id"), "hash", "fresh")


def page_files(p: DataFrame) -> DataFrame:
    path = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    return p.select(F.regexp_extract(path, "^[^/]*", 0).alias("project_id"), path.alias("path"), F.lit("html").alias("language"), F.sha2("html", 256).alias("hash"), F.col("html").alias("content"))


@query("pages")
def page_chunks(p):
    return C.code_chunks(page_files(p), 500, 625, 20).select("project_id", "file_path", "start_line", "end_line", "chunk_type", "name", "token_count", "id")


@query("documents", sql="SELECT doc_id, len(string_split(text, chr(10))) AS methods, len(string_split(text, chr(10))) + 2 AS last_line, 'm' || (len(string_split(text, chr(10))) - 1) AS last FROM documents")
def declared_methods(d):
    """Documents as classes with a method a line, the line in a comment and its
    beginning in a string: brackets and words in either declare nothing."""
    quoted = lambda x: F.to_json(F.struct(F.substring(x, 1, 200).alias("x")))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("  m"), i.cast("string"), F.lit("() { f("), quoted(x), F.lit("); } // "), x))
    text = F.concat(F.lit("class D {\n"), F.array_join(lines, "\n"), F.lit("\n}"))
    files = d.select(F.lit("p").alias("project_id"), F.col("doc_id").cast("string").alias("path"), F.lit("typescript").alias("language"), F.lit("").alias("hash"), text.alias("content"))
    chunks = C.code_chunks(files, 1 << 30, 1 << 30, 0)
    last = F.max_by("name", F.when(F.col("chunk_type") == "method", F.col("start_line")))
    return chunks.groupBy(F.col("file_path").cast("long").alias("doc_id")).agg(F.count_if(F.col("chunk_type") == "method").alias("methods"), F.max("end_line").cast("long").alias("last_line"), last.alias("last"))


@query("documents", "labels", sql="SELECT doc_id, md5(CASE WHEN quality = 0 THEN text || '!' ELSE text END) AS hash FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0")
def stored_updates(d, labels):
    """Files of a store after two updates: in the second the documents of quality
    0 changed and the toxic ones left."""
    spark, path = d.sparkSession, shared_folder(d.sparkSession, "store")
    files = lambda rows, text: rows.select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("language"), F.md5(text).alias("hash"), text.alias("content"))
    embed, now = embedding.hashed_words(8), F.lit("2024-01-01").cast("timestamp")
    store.update_store(spark, files(d, F.col("text")), path, embed, now)
    known = d.join(labels, "doc_id")
    gone = files(known.where("toxic = 1"), F.col("text")).select("project_id", "path")
    store.update_store(spark, files(known.where("quality = 0 AND toxic = 0"), F.concat("text", F.lit("!"))), path, embed, now, removed=gone)
    return store.read_store(spark, path).select(F.col("file_path").cast("long").alias("doc_id"), F.col("file_hash").alias("hash")).distinct()


@query("events", sql="SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL")
def kept_days(e):
    """Counts of a log in day folders after the days before one were deleted and
    the others merged."""
    spark, path = e.sparkSession, shared_folder(e.sparkSession, "days")
    retention.append_days(e, path)
    retention.forget_days(spark, path, datetime.date(2024, 1, 15))
    retention.merge_days(spark, path, 1)
    return retention.read_days(spark, path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type").agg(count().alias("n"))


@query("documents", "benchmark")
def text_search(d, b):
    """The ten documents nearest to a text by hashed words."""
    embed = embedding.hashed_words()
    rows = d.select(F.col("doc_id").alias("file_path"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("file").alias("chunk_type"), F.lit("").alias("name"), F.col("lang").alias("language"))
    text = b.orderBy("item_id").select("text").first()[0]
    return indexing.search(embedding.embed_texts(rows, embed), text, embed, 10, 0.0).select(F.col("file_path").alias("doc_id"), F.round("score", 6).alias("score"))


@query("documents", "labels", sql="SELECT CASE WHEN l.quality = 1 THEN 'hit' ELSE 'embedded' END AS way, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1 GROUP BY 1")
def embedding_cache(d, labels):
    """How many vectors came from the cache, and how many were made."""
    embed = embedding.hashed_words(32)
    chunks = d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    known = chunks.join(labels.where("quality = 1").select(F.col("doc_id").alias("id")), "id")
    cache = known.select(F.col("id").alias("chunk_id"), F.sha2("content", 256).alias("content_hash"), F.lit("hashed").alias("model"), F.array(F.lit(0.0).cast("float")).alias("vector"))
    rows, _ = embedding.embed_with_cache(chunks, cache, "hashed", embed)
    return rows.groupBy(F.when(F.size("vector") == 1, "hit").otherwise("embedded").alias("way")).agg(count().alias("n"))
