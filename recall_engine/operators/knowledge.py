"""Documents about a project: parsing and rendering their lists, gates by
fingerprint, and summaries by map and reduce."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.functions.text import token_count
from recall_engine.operators.chunking import budget_batches
from recall_engine.operators.ranges import settled

# Marks of blockers by severity and of decisions by category.
SEVERITY_MARKS = {"high": "🔴", "medium": "🟡", "low": "🟢"}
CATEGORY_MARKS = {"architecture": "🏗️", "technology": "💻", "dependencies": "📦"}

Summarise = Callable[[str], str]


def section(text: Column, title: str) -> Column:
    """The lines below a heading of level two or three, up to the next heading."""
    return F.regexp_extract(text, rf"(?sm)^#{{2,3}} {title}[ \t]*\n(.*?)(?=^#{{1,3}} |\z)", 1)


def checklist(text: Column, done: bool) -> Column:
    """Titles of a section's ticked or open items, in order."""
    mark = "[xX]" if done else " "
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?m)^[-*] \[{mark}\][ \t]+(\S.*)$"), 1), lambda x: F.trim(x))


def table_rows(text: Column) -> Column:
    """Cells of each row of a table, without its head and rule."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.startswith("|"))
    body = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    return F.transform(body, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|\s*$", ""), r"\|", -1), lambda y: F.trim(y)))


def render_checklist(rows: DataFrame, by: str, title: str, done: str, order: str) -> DataFrame:
    """(by, text): a line for each row, ticked where ``done`` holds."""
    line = F.concat(F.when(F.col(done), "- [x] ").otherwise("- [ ] "), F.col(title))
    items = F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("text"))


def merge_titles(kept: DataFrame, new: DataFrame, by: str, title: str, order: str) -> DataFrame:
    """Both lists, those kept first; of titles equal but for case the first stays."""
    both = kept.select(by, title, order, F.lit(0).alias("_side")).unionByName(new.select(by, title, order, F.lit(1).alias("_side")))
    first = F.struct("_side", order, title)
    return both.groupBy(by, F.lower(title).alias("_low")).agg(F.min(first).alias("x")).select(by, F.col(f"x.{title}").alias(title), F.col("x._side").alias("side"), F.col(f"x.{order}").alias(order))


def still_open(in_progress: DataFrame, completed: DataFrame, by: str, title: str) -> DataFrame:
    """Tasks in progress that the completed ones don't hold, whatever their case."""
    done = completed.select(F.col(by), F.lower(title).alias("_low")).distinct()
    return in_progress.withColumn("_low", F.lower(title)).join(done, [by, "_low"], "left_anti").drop("_low")


def mark_of(value: Column, marks: dict[str, str], default: str) -> Column:
    known = F.create_map(*(F.lit(x) for pair in marks.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(value)), F.lit(default))


def json_object(text: Column) -> Column:
    """The text from the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def to_generate(wanted: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Documents (project_id, type, fingerprint) whose fingerprint isn't the stored one."""
    return wanted if force else wanted.join(stored, ["project_id", "type", "fingerprint"], "left_anti")


def recent_history(rows: DataFrame, by: str, order: list[str], most: int = 10) -> DataFrame:
    """The ``most`` latest rows of each key with their place, the newest first."""
    latest = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= most)


def render_prompt(template: str, values: dict[str, Column]) -> Column:
    """A template with its {{names}} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value.cast("string"))
    return out


def first_characters(most: int = 500) -> Summarise:
    """The start of a text, for previews: what follows leaves no trace."""
    return lambda text: text[:most]


_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_WORD = re.compile(r"\w{4,}")


def _frequencies(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def _fitted(parts: list[str], scores: list[float], most: int) -> list[str]:
    """The best parts that fit into ``most`` characters with spaces between them, in order."""
    kept, left = [], most + 1
    for k in sorted(range(len(parts)), key=lambda k: (-scores[k], k)):
        if len(parts[k]) < left:
            kept.append(k)
            left -= len(parts[k]) + 1
    return [parts[k] for k in sorted(kept)]


class Extract:
    """A summary without a model: whole sentences of the text, those whose words
    of four letters and more are the most frequent, in one line.

    Where no sentence of at least half the best score fits, the best words of
    the best sentence stand for it, one at least.
    """

    def __init__(self, most: int = 500):
        self.most = most

    def __call__(self, text: str) -> str:
        return self._line(text, _frequencies(text), self.most)

    def batch(self, text: str) -> str:
        """A summary of joined summaries: each line has a share of the
        characters, what short lines don't need goes to the others, and no line
        goes without a word.  Words count the less the more lines hold them."""
        lines = [x for x in text.split("\n") if x.strip()]
        own = [_frequencies(x) for x in lines]
        held = Counter(w for x in own for w in x)
        left, shares = self.most + 1, {}
        for n, k in enumerate(sorted(range(len(lines)), key=lambda k: len(lines[k]))):
            shares[k] = min(len(lines[k]), left // (len(lines) - n) - 1)
            left -= shares[k] + 1
        often = [Counter({w: n * math.log(1 + len(lines) / held[w]) for w, n in x.items()}) for x in own]
        return "\n".join(self._line(x, often[k], shares[k]) for k, x in enumerate(lines))

    def _line(self, text: str, often: Counter, most: int) -> str:
        whole = " ".join(text.split())
        if len(whole) <= most:
            return whole
        parts = list(dict.fromkeys(y for x in _SENTENCE.findall(text) if (y := " ".join(x.split()))))
        weights = [sum(often[w] for w in words) / len(words) if (words := _WORD.findall(x.lower())) else 0.0 for x in parts]
        kept = _fitted(parts, weights, most)
        top = max((w for x, w in zip(parts, weights, strict=True) if len(x) <= most), default=-1.0)
        if 2 * top < max(weights, default=0.0) or not kept:
            words = list(dict.fromkeys((parts[max(range(len(parts)), key=weights.__getitem__)] if parts else whole).split()))
            weights = [max((often[w] for w in _WORD.findall(x.lower())), default=0) for x in words]
            kept = _fitted(words, weights, most) or [words[max(range(len(words)), key=weights.__getitem__)][: max(most, 20)]]
        return " ".join(kept)


def summarise_to_budget(chunks: DataFrame, summarise: Summarise, *, threshold: int = 100_000, most: int = 80_000, depth: int = 3, by: str = "project_id") -> DataFrame:
    """(by, seq, path, content): chunks whose tokens fit a prompt.

    Keys within ``threshold`` tokens keep their chunks.  In each of at most
    ``depth`` rounds the others are cut into batches of ``most`` tokens, each
    chunk of a batch is summarised where it lies, and a batch's summaries
    become one chunk.  From the second round on chunks are joined summaries, and
    ``summarise.batch`` is used if there is one.  Keys still too large then keep
    an Extract of about 500 characters of each chunk, with a share for each line.
    """
    rows = chunks.select(by, "seq", "path", F.coalesce("content", F.lit("")).alias("content"))

    def each(shorten: Summarise) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(content=[shorten(x) for x in frame["content"]])

        return run

    def large(x: DataFrame) -> DataFrame:
        return x.groupBy(by).agg(F.sum(token_count(F.col("content"))).alias("_tokens")).where(F.col("_tokens") > threshold).select(by)

    for k in range(depth):
        over = large(rows)
        costs = rows.join(over, by).withColumn("cost", token_count(F.col("content")) + token_count(F.col("path")) + 20)
        dealt = budget_batches(costs, most, by, "seq", "cost").drop("cost")
        short = dealt.mapInPandas(each(getattr(summarise, "batch", summarise) if k else summarise), dealt.schema)
        parts = F.array_sort(F.collect_list(F.struct("seq", "content")))
        joined = short.groupBy(by, "batch").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("content"))
        rows = rows.join(over, by, "left_anti").unionByName(joined.select(by, F.col("batch").cast("long").alias("seq"), F.lit("summary").alias("path"), "content"))
        rows = settled(rows)
    over, last = large(rows), Extract(500)
    cut = rows.join(over, by).select(*rows.columns)
    return rows.join(over, by, "left_anti").unionByName(cut.mapInPandas(each(last.batch if depth else last), cut.schema))


def decision_count(text: Column) -> Column:
    """Decisions of a log: headings of level three that begin with a date."""
    return F.regexp_count(text, F.lit(r"(?m)^### \d{4}-\d{2}-\d{2}")).cast("long")


def bullets(items: Column, empty: str, mark: str = "- ") -> Column:
    """A line for each item of an array, or one that says there is none."""
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, lines).otherwise(F.lit(mark + empty))


def decision_entry(date: Column, title: Column, decision: Column, rationale: Column, alternatives: Column, impact: Column, category: Column) -> Column:
    """The entry of a decision in the log; parts that are null or empty are left out."""
    mark = mark_of(F.coalesce(category, F.lit("")), CATEGORY_MARKS, "📌")
    part = lambda head, value: F.when(value != "", F.concat(F.lit(f"\n**{head}**"), value, F.lit("\n"))).otherwise("")
    others = F.when(F.coalesce(F.size(alternatives), F.lit(0)) > 0, F.concat(F.lit("\n**Alternatives Considered**:\n"), bullets(alternatives, ""), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("### "), date, F.lit(" - "), mark, F.lit(" "), title, F.lit("\n\n**Decision**: "), decision, F.lit("\n\n**Rationale**: "), rationale, F.lit("\n"))
    return F.concat(head, others, F.coalesce(part("Impact", F.concat(F.lit(": "), F.nullif(impact, F.lit("")))), F.lit("")), F.coalesce(part("Category", F.concat(F.lit(": "), mark, F.lit(" "), F.nullif(category, F.lit("")))), F.lit("")), F.lit("\n---\n"))


def with_entry(log: Column, entry: Column, head: str = "## Decisions") -> Column:
    """A log with an entry below its heading, above those before; without the
    heading it comes with it at the end."""
    place = F.instr(log, F.lit(f"{head}\n"))
    before = F.substring(log, F.lit(1), (place + len(head)).cast("int"))
    after = F.substring(log, (place + len(head) + 1).cast("int"), F.length(log))
    return F.when(place > 0, F.concat(before, F.lit("\n"), entry, after)).otherwise(F.concat(F.coalesce(log, F.lit("")), F.lit(f"\n{head}\n\n"), entry))


def active_context(session: DataFrame, history: DataFrame, by: str, most: int = 10) -> DataFrame:
    """(by, text): the active context of each project.

    session: (by, date, mode, task, changes, questions, steps, notes), one row
    each; history: (by, date, mode, task, notes, seq), of which the latest
    sessions are listed after the one at hand.
    """
    row = lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", x["date"], x["mode"], x["task"], x["notes"]), F.lit(" |"))
    old = recent_history(history, by, ["seq"], most - 1).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "date", "mode", "task", "notes"))).alias("_old"))
    now = session.join(old, by, "left")
    note = F.coalesce(F.nullif("notes", F.lit("")), F.lit("Session updated"))
    first = F.struct("date", "mode", "task", note.alias("notes"))
    table = F.array_join(F.concat(F.array(row(first)), F.coalesce(F.transform("_old", row), F.array().cast("array<string>"))), "\n")
    parts = [
        F.lit("# Active Context\n\n## Current Session\n- **Date**: "), F.col("date"), F.lit("\n- **Mode**: "), F.col("mode"), F.lit("\n- **Current Task**: "), F.col("task"),
        F.lit("\n\n## Session History\n| Date | Mode | Task | Notes |\n|------|------|------|-------|\n"), table,
        F.lit("\n\n## Recent Changes\n"), bullets(F.col("changes"), "No recent changes recorded"),
        F.lit("\n\n## Open Questions\n"), bullets(F.col("questions"), "No open questions"),
        F.lit("\n\n## Next Steps\n"), bullets(F.col("steps"), "Continue development", "- [ ] "),
        F.lit("\n\n## Active Considerations\n"), F.coalesce(F.nullif("notes", F.lit("")), F.lit("_No additional considerations_")), F.lit("\n"),
    ]
    return now.select(by, F.concat(*parts).alias("text"))


def documents_to_update(changed: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, documents): which documents changed paths (by, path) make out of date:
    the running ones always, the technical one for a configuration file, the
    brief for an entry file, patterns and product above five files."""
    name = F.lower(F.substring_index("path", "/", -1))
    config = F.bool_or(name.rlike(r"^(package\.json|tsconfig\.json|dockerfile|makefile|pyproject\.toml|cargo\.toml|go\.mod)$|config"))
    entry = F.bool_or(name.rlike(r"^(index|main|app|readme)\b"))
    found = changed.groupBy(by).agg(config.alias("c"), entry.alias("e"), F.count(F.lit(1)).alias("n"))
    some = F.col("n") > 5
    wanted = [F.lit("activeContext"), F.lit("progress"), F.when(F.col("c"), "techContext"), F.when(F.col("e"), "projectBrief"), F.when(some, "systemPatterns"), F.when(some, "productContext")]
    return found.select(by, F.array_compact(F.array(*wanted)).alias("documents"))


def document_summary(documents: DataFrame, reasoner: Callable[[str], str], by: str = "project_id") -> DataFrame:
    """(by, summary): the JSON object that a reasoner makes of each project's
    brief, patterns and product documents (by, name, text); null where its
    answer holds none.  Calls are made where the documents lie."""
    parts = documents.where(F.col("name").isin("projectBrief", "systemPatterns", "productContext", "techContext"))
    prompts = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("x")).select(by, F.array_join(F.transform("x", lambda d: F.concat(F.lit("## "), d["name"], F.lit("\n"), d["text"])), "\n\n").alias("prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(answer=[reasoner(x) for x in frame["prompt"]]).drop(columns="prompt")

    kind = prompts.schema[by].dataType.simpleString()
    return prompts.mapInPandas(run, f"{by} {kind}, answer string").select(by, json_object(F.col("answer")).alias("summary"))


def entry_rank(path: Column) -> Column:
    """Order in which files tell most of a project: what is called readme, index,
    main or app comes first."""
    out = F.lit(9)
    for place, word in reversed([*enumerate(["readme", "index", "main", "app"], 1)]):
        out = F.when(F.lower(path).contains(word), place).otherwise(out)
    return out


def generate_documents(wanted: DataFrame, stored: DataFrame, reasoner: Callable[[str], str], force: bool = False) -> DataFrame:
    """(project_id, type, fingerprint, text, state) of wanted documents
    (project_id, type, fingerprint, prompt): those whose stored fingerprint
    differs are 'generated', or 'updated' where another one was stored, by the
    reasoner, where their rows lie; the others are 'skipped', with a null text."""
    old = stored.select("project_id", "type", F.col("fingerprint").alias("_old"))
    each = wanted.join(old, ["project_id", "type"], "left")
    same = F.coalesce(F.col("_old") == F.col("fingerprint"), F.lit(False)) & F.lit(not force)
    marked = each.select("project_id", "type", "fingerprint", "prompt", F.when(same, "skipped").when(F.col("_old").isNull(), "generated").otherwise("updated").alias("state"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [None if s == "skipped" else reasoner(p) for p, s in zip(frame["prompt"], frame["state"], strict=True)]
            yield frame.assign(text=text)[["project_id", "type", "fingerprint", "text", "state"]]

    kind = wanted.schema["project_id"].dataType.simpleString()
    return marked.mapInPandas(run, f"project_id {kind}, type string, fingerprint string, text string, state string")
