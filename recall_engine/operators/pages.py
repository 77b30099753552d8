"""Pages rendered from tables: a board, the documents of a project, and the
chunks of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions.text import preview, time_of_day, token_count
from recall_engine.operators.knowledge import Summarise, recent_history, summarise_to_budget

# Headings of a board's sections and of their tables.
BOARD_SECTIONS = [
    ("Active Agents", ["Agent ID", "Status", "Current Focus", "Session ID", "Last Heartbeat"]),
    ("Pending Tasks", ["ID", "Title", "From", "Status", "Created At"]),
    ("File Locks", ["File Pattern", "Claimed By", "Since"]),
    ("Agent Messages", []),
]
# File names that come first in a prompt, in this order.
PROMPT_FIRST = ["package.json", "readme", "index", "main", "app"]


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells)), F.lit(" |"))


def board_page(agents: DataFrame, tasks: DataFrame, locks: DataFrame, messages: DataFrame, most: int = 20) -> DataFrame:
    """(project_id, text): the board of each project that any table names.

    agents (project_id, agent_id, status, focus, session_id, last_seen), the last
    seen first; tasks (project_id, task_id, title, sender, status, created_at),
    the pending ones, oldest first; locks (project_id, resource, holder, since),
    oldest first; messages (project_id, ts, seq, agent_id, message), the ``most``
    latest, oldest first, with their time of day.  Nulls are empty cells, a task
    without a sender is from '-'.  Lines of all sections meet in one shuffle; a
    page is one row, as long as its board.
    """

    def part(rows: DataFrame, number: int, order: Column, tie: str, line: Column) -> DataFrame:
        return rows.select("project_id", F.struct(F.lit(number).alias("part"), order.cast("long").alias("order"), F.col(tie).cast("string").alias("tie"), line.alias("line")).alias("x"))

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    last = recent_history(messages, "project_id", ["ts", "seq"], most)
    lines = part(agents, 0, -micros("last_seen"), "agent_id", _cells(*map(F.col, ("agent_id", "status", "focus", "session_id", "last_seen"))))
    lines = lines.unionByName(part(tasks, 1, micros("created_at"), "task_id", _cells(F.col("task_id"), F.col("title"), F.coalesce(F.nullif(F.col("sender").cast("string"), F.lit("")), F.lit("-")), F.col("status"), F.col("created_at"))))
    lines = lines.unionByName(part(locks, 2, micros("since"), "resource", _cells(*map(F.col, ("resource", "holder", "since")))))
    said = F.concat(F.lit("- ["), F.coalesce(time_of_day(F.col("ts")), F.lit("")), F.lit("] **"), F.coalesce("agent_id", F.lit("")), F.lit("**: "), F.coalesce("message", F.lit("")))
    lines = lines.unionByName(part(last, 3, -F.col("place"), "agent_id", said))
    held = lines.groupBy("project_id").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def own(number: int) -> Column:
        return F.array_join(F.transform(F.filter("x", lambda x: x["part"] == number), lambda x: F.concat(x["line"], F.lit("\n"))), "")

    body = [F.lit("# Multi-Agent Board\n")]
    for number, (title, heads) in enumerate(BOARD_SECTIONS):
        table = f"| {' | '.join(heads)} |\n|{'---|' * len(heads)}\n" if heads else ""
        body += [F.lit(f"\n## {title}\n{table}"), own(number)]
    return held.select("project_id", F.concat(*body).alias("text"))


def documents_page(projects: DataFrame, documents: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(project_id, text): lines 2 to 6 of each document under its title, in the
    order of ``titles`` (type: title); projects without any get a line that says so.

    documents: (project_id, type, text, generated_at); of one type the latest
    counts; other types don't.  Only the previews are gathered, one a type.
    """
    places = F.create_map(*(F.lit(x) for place, kind in enumerate(titles) for x in (kind, place)))
    names = F.create_map(*(F.lit(x) for pair in titles.items() for x in pair))
    rows = documents.where(F.col("type").isin(*titles)).select("project_id", "type", preview(F.coalesce("text", F.lit(""))).alias("preview"), F.col("generated_at").cast("timestamp").alias("at"))
    latest = rows.groupBy("project_id", "type").agg(F.max(F.struct("at", "preview")).alias("x"))
    stamp = F.coalesce(F.date_format("x.at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("Unknown"))
    title = F.concat(F.lit("## "), F.element_at(names, F.col("type")), F.lit("\n*Last generated: "), stamp, F.lit("*\n\n"))
    parts = latest.select("project_id", F.element_at(places, F.col("type")).alias("place"), F.concat(title, "x.preview", F.lit("\n\n---\n\n")).alias("part"))
    held = parts.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("p"))
    text = F.concat(F.lit("# Project Documentation Summary\n\n"), F.array_join(F.transform("p", lambda x: x["part"]), ""))
    return projects.select("project_id").distinct().join(held, "project_id", "left").select("project_id", F.coalesce(text, F.lit("No documents were generated for this project yet.")).alias("text"))


def prompt_place(path: Column) -> Column:
    """Place of a file in a prompt: by the first of PROMPT_FIRST in its name; others last."""
    name, out = F.lower(F.substring_index(path, "/", -1)), F.lit(len(PROMPT_FIRST))
    for place in reversed(range(len(PROMPT_FIRST))):
        out = F.when(name.contains(PROMPT_FIRST[place]), place).otherwise(out)
    return out


def prompt_texts(chunks: DataFrame, summarise: Summarise, *, most: int = 50, threshold: int = 100_000, batch: int = 80_000) -> DataFrame:
    """(project_id, text, summarised): the ``most`` first chunks of each project,
    each with a line that names it; above ``threshold`` tokens their summaries.

    chunks: (project_id, seq, path, language, chunk_type, name, content); seq
    settles the order of files of one place.  Only the first chunks of a
    partition are shuffled, as the limit on the rank goes before the exchange.
    """
    order = Window.partitionBy("project_id").orderBy("_place", "seq", "path")
    first = chunks.withColumn("_place", prompt_place(F.col("path"))).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    kind = F.concat(F.col("chunk_type"), F.when(F.col("name") != "", F.concat(F.lit(": "), "name")).otherwise(""))
    block = F.concat(F.lit("--- File: "), "path", F.lit(" ("), F.coalesce("language", F.lit("")), F.lit(") ["), F.coalesce(kind, F.lit("")), F.lit("] ---\n"), F.coalesce("content", F.lit("")), F.lit("\n---"))
    blocks = first.select("project_id", F.col("_rank").cast("long").alias("seq"), "path", block.alias("content"))
    short = summarise_to_budget(blocks, summarise, threshold=threshold, most=batch)
    over = blocks.groupBy("project_id").agg((F.sum(token_count(F.col("content"))) > threshold).alias("summarised"))
    held = short.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("x"))
    return held.join(over, "project_id").select("project_id", F.array_join(F.transform("x", lambda x: x["content"]), "\n\n").alias("text"), "summarised")
