"""The progress page of a project: parsed, merged with an update, and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.functions.text import task_id
from recall_engine.operators.knowledge import checklist, mark_of, section, table_rows

# What a page says where nothing else is known.  The task and the
# milestone are entries like others for whoever reads the page.
FIRST_TASK = "Project initialization"
FIRST_MILESTONE = ("Initial Setup", "In Progress", "-", "Getting started")
FIRST_PHASE = ("Development", "In Progress")
# Marks of blockers on this page, by severity.
BLOCKER_MARKS = {"low": "🟡", "medium": "🟠", "high": "🔴"}

MILESTONE = "struct<name:string,status:string,target:string,notes:string>"
UPDATE = f"project_id string, completed array<string>, in_progress array<string>, blocked array<string>, upcoming array<string>, milestone {MILESTONE}, blockers array<struct<severity:string,description:string>>, phase string, phase_status string"


def _some(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def _list(items: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(items, F.array().cast(kind))


def merged_titles(kept: Column, new: Column) -> Column:
    """kept and what ``new`` adds: of titles equal but for case the first stays."""

    def add(held: Column, x: Column) -> Column:
        return F.when(F.exists(held, lambda y: F.lower(y) == F.lower(x)), held).otherwise(F.array_append(held, x))

    return F.aggregate(_list(new), _list(kept), add)


def without_titles(kept: Column, gone: Column) -> Column:
    """kept less the titles of ``gone``, whatever their case."""
    low = F.transform(_list(gone), F.lower)
    return F.filter(_list(kept), lambda x: ~F.array_contains(low, F.lower(x)))


def with_milestone(kept: Column, new: Column) -> Column:
    """kept with a milestone in the place of the first of its name, or at the end."""
    dash = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("-"))
    filled = F.struct(new["name"].alias("name"), new["status"].alias("status"), dash(new["target"]).alias("target"), dash(new["notes"]).alias("notes"))
    place = F.array_position(F.transform(kept, lambda m: F.lower(m["name"])), F.lower(new["name"]))
    swapped = F.transform(kept, lambda m, i: F.when(i + 1 == place, filled).otherwise(m))
    return F.when(new.isNull() | new["name"].isNull(), kept).when(place > 0, swapped).otherwise(F.array_append(kept, filled))


def parsed_progress(text: Column) -> dict[str, Column]:
    """The lists, milestones and phase of a page; nothing of a null or empty one.
    Blocked tasks and blockers are those of one update and aren't read back."""
    rows = F.filter(F.transform(table_rows(section(text, "Milestones")), lambda r: F.filter(r, lambda c: c != "")), lambda r: F.size(r) >= 4)
    field = lambda head, other: F.coalesce(F.nullif(F.regexp_extract(text, rf"\*\*{head}\*\*: (.+)", 1), F.lit("")), F.lit(other))
    return {
        "completed": _list(checklist(section(text, "Completed"), True)),
        "in_progress": _list(checklist(section(text, "In Progress"), False)),
        "upcoming": _list(checklist(section(text, "Upcoming"), False)),
        "milestones": _list(F.transform(rows, lambda r: F.struct(r[0].alias("name"), r[1].alias("status"), r[2].alias("target"), r[3].alias("notes"))), f"array<{MILESTONE}>"),
        "phase": field("Phase", FIRST_PHASE[0]),
        "phase_status": field("Status", FIRST_PHASE[1]),
    }


def progress_page(date: Column) -> Column:
    """The page of columns completed, in_progress, blocked, upcoming, milestones,
    blockers, phase and phase_status."""

    def lines(items: str, mark: str, empty: str) -> Column:
        return F.when(_some(F.col(items)), F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")).otherwise(F.lit(empty))

    def row(*cells: Column) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    table = F.array_join(F.transform("milestones", lambda m: row(m["name"], m["status"], m["target"], m["notes"])), "\n")
    blockers = F.transform("blockers", lambda b: F.concat(F.lit("- "), mark_of(F.coalesce(b["severity"], F.lit("")), BLOCKER_MARKS, "🟡"), F.lit(" **"), F.upper(F.coalesce(b["severity"], F.lit("low"))), F.lit("**: "), F.coalesce(b["description"], F.lit(""))))
    count = lambda head, items: F.concat(F.lit(f"\n- **{head}**: "), F.size(items).cast("string"))
    return F.concat(
        F.lit("# Progress Tracking\n\n## Current Phase\n**Phase**: "), F.col("phase"), F.lit("\n**Status**: "), F.col("phase_status"), F.lit("\n**Last Updated**: "), date,
        F.lit("\n\n## Completed\n"), lines("completed", "- [x] ", f"- [x] {FIRST_TASK}"),
        F.lit("\n\n## In Progress\n"), lines("in_progress", "- [ ] ", "_Nothing under way_"),
        F.when(_some(F.col("blocked")), F.concat(F.lit("\n\n### Blocked\n"), lines("blocked", "- [ ] ⚠️ ", ""))).otherwise(""),
        F.lit("\n\n## Upcoming\n"), lines("upcoming", "- [ ] ", "_Nothing planned_"),
        F.lit("\n\n## Blockers\n"), F.when(_some(F.col("blockers")), F.array_join(blockers, "\n")).otherwise("_None_"),
        F.lit("\n\n## Milestones\n| Milestone | Status | Target Date | Notes |\n|-----------|--------|-------------|-------|\n"), F.when(_some(F.col("milestones")), table).otherwise(row(*map(F.lit, FIRST_MILESTONE))),
        F.lit("\n\n## Statistics"), count("Completed", "completed"), count("In Progress", "in_progress"), count("Blocked", "blocked"), count("Upcoming", "upcoming"), F.lit("\n"),
    )


def track_progress(pages: DataFrame, updates: DataFrame, date: Column) -> DataFrame:
    """(project_id, text, updated, created, and the size of each list) of every
    update (UPDATE, one row a project) whose project has a row in ``pages``
    (project_id, text; a null text begins a page).  The others give no row.

    Completed tasks leave those in progress; other lists get what they lack.
    updated names the sections that the update touched, created holds the tasks
    new in progress.  Null and empty fields of an update leave what there was;
    blocked tasks and blockers are those of the update.  One join; each page is
    made within its row.
    """
    rows = updates.select("project_id", F.struct(*(c for c in updates.columns if c != "project_id")).alias("u")).join(pages.select("project_id", F.col("text").alias("_text")), "project_id")
    old = parsed_progress(F.coalesce("_text", F.lit("")))
    # columns of their own: fields of a struct would be computed at each use
    rows = rows.select("project_id", "u", *(c.alias(f"_{n}") for n, c in old.items()))
    u, o = (lambda name: F.col(f"u.{name}")), (lambda name: F.col(f"_{name}"))
    given = lambda name: F.nullif(u(name), F.lit("")).isNotNull()
    touched = {"Completed": _some(u("completed")), "In Progress": _some(u("in_progress")), "Blocked": _some(u("blocked")), "Upcoming": _some(u("upcoming")), "Milestones": u("milestone.name").isNotNull(), "Phase": given("phase") | given("phase_status"), "Blockers": _some(u("blockers"))}
    merged = rows.select(
        "project_id",
        merged_titles(o("completed"), u("completed")).alias("completed"),
        merged_titles(without_titles(o("in_progress"), u("completed")), u("in_progress")).alias("in_progress"),
        merged_titles(F.array().cast("array<string>"), u("blocked")).alias("blocked"),
        merged_titles(o("upcoming"), u("upcoming")).alias("upcoming"),
        with_milestone(o("milestones"), u("milestone")).alias("milestones"),
        _list(u("blockers"), "array<struct<severity:string,description:string>>").alias("blockers"),
        F.when(given("phase"), u("phase")).otherwise(o("phase")).alias("phase"),
        F.when(given("phase_status"), u("phase_status")).otherwise(o("phase_status")).alias("phase_status"),
        F.array_compact(F.array(*(F.when(c, name) for name, c in touched.items()))).alias("updated"),
        without_titles(u("in_progress"), o("in_progress")).alias("created"),
    )
    sizes = [F.size(c).alias(f"n_{c}") for c in ("completed", "in_progress", "blocked", "upcoming", "milestones", "blockers")]
    return merged.select("project_id", progress_page(date).alias("text"), "updated", "created", *sizes)


def created_tasks(tracked: DataFrame, agent_id: str, now: Column) -> DataFrame:
    """Rows of a task log (project_id, task_id, action, agent_id, title,
    description, ts, seq) that create the tasks new in progress, a millisecond
    apart in their project so that no two share an id."""
    each = tracked.select("project_id", F.posexplode("created").alias("seq", "title"))
    at = F.timestamp_millis(F.unix_millis(now) + F.col("seq"))
    rows = each.select("project_id", task_id(at).alias("task_id"), F.lit("create").alias("action"), F.lit(agent_id).alias("agent_id"), "title", F.lit("Taken from the progress page").alias("description"), at.alias("ts"))
    return rows.withColumn("seq", F.unix_micros("ts"))
