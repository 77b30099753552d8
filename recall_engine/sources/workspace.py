"""A workspace's root, its document folders and its registry of projects."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.functions.text import document_name
from recall_engine.operators.knowledge import bullets
from recall_engine.sources.files import put_text
from recall_engine.sources.ignore import read_text

# What marks the root of a workspace; the documents of a project;
# other names by which they are asked for.
ROOT_MARKS = [".git", "package.json", "pom.xml", "build.gradle", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py", ".project"]
DOCUMENTS = ["projectBrief", "productContext", "systemPatterns", "techContext", "activeContext", "progress", "decisionLog", "agentBoard"]
ALIASES = {
    "decisions": "decisionLog",
    "active": "activeContext",
    "context": "projectBrief",
    "patterns": "systemPatterns",
    "brief": "projectBrief",
    "tech": "techContext",
    "product": "productContext",
}
#: Sections that a new document begins with.
SECTIONS = {
    "projectBrief": ["Goals", "Scope"],
    "productContext": ["Users", "Problems"],
    "systemPatterns": ["Architecture", "Patterns"],
    "techContext": ["Technologies", "Constraints"],
    "activeContext": ["Current Session", "Session History", "Next Steps"],
    "progress": ["Completed", "In Progress", "Upcoming"],
    "decisionLog": ["Decisions"],
    "agentBoard": ["Agents", "Locks"],
}


def workspace_root(path: str) -> str:
    """The nearest folder from ``path`` upwards that holds a mark of a root or a
    solution file; ``path`` itself if there is none."""
    at = os.path.abspath(path)
    while True:
        if os.path.isdir(at):
            names = os.listdir(at)
            if any(m in names for m in ROOT_MARKS) or any(n.endswith(".sln") for n in names):
                return at
        above = os.path.dirname(at)
        if above == at:
            return os.path.abspath(path)
        at = above


def initial_documents(projects: DataFrame) -> DataFrame:
    """(project_id, name, text): the documents that a project (project_id, title,
    date) begins with."""
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, SECTIONS[name])).alias("sections")) for name in DOCUMENTS)))
    each = projects.select("*", kinds.alias("d"))
    head = F.concat(F.lit("# "), F.col("d.name"), F.lit(": "), F.col("title"), F.lit("\n\n*Begun: "), F.col("date").cast("string"), F.lit("*\n"))
    body = F.array_join(F.transform("d.sections", lambda s: F.concat(F.lit("\n## "), s, F.lit("\n\n"))), "")
    return each.select("project_id", F.col("d.name").alias("name"), F.concat(head, body).alias("text"))


def write_documents(spark: SparkSession, documents: DataFrame, folder: str, overwrite: bool = False) -> list[str]:
    """Writes one project's documents (name, text) below ``folder``, those that
    are there already only if asked to; the names written.  A project has a
    handful, so they go through the driver."""
    out = []
    for row in documents.select("name", "text").toLocalIterator():
        path = f"{folder}/{row['name']}.md"
        if overwrite or read_text(spark, path) is None:
            put_text(spark, path, row["text"])
            out.append(row["name"])
    return out


def asked_documents(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """asked (project_id, name) with ``text``: by its own name, an alias, or the
    name as it is normalised; a message where there is none."""
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    wanted = asked.withColumn("_key", document_name(F.coalesce(F.try_element_at(alias, F.col("name")), F.col("name"))))
    held = documents.select("project_id", document_name(F.col("name")).alias("_key"), F.col("text").alias("_text"))
    missing = F.concat(F.lit("No document "), "name", F.lit(" of project "), "project_id")
    return wanted.join(held, ["project_id", "_key"], "left").select(*asked.columns, F.coalesce("_text", missing).alias("text"))


CARD = "project_id string, path string, description string, keywords array<string>, status string, last_active string"


def read_registry(spark: SparkSession, path: str, folders: DataFrame) -> DataFrame:
    """The cards (CARD) of a registry file {"projects": [...]}.

    A file that is missing, empty, broken or without projects gives a bare card
    for each project folder there is (project_id, path); a broken file is kept
    beside as .bak."""
    text = read_text(spark, path)
    try:
        cards = json.loads(text)["projects"] if text and text.strip() else []
        if not isinstance(cards, list):
            raise ValueError("projects is no list")
    except (ValueError, KeyError, TypeError):
        put_text(spark, f"{path}.bak", text or "")
        cards = []
    if cards:
        rows = spark.createDataFrame([(json.dumps(c),) for c in cards], "card string")
        return rows.select(F.from_json("card", CARD).alias("c")).select("c.*").where("project_id IS NOT NULL")
    return folders.select("project_id", "path", *(F.lit(None).cast(kind).alias(name) for name, kind in (("description", "string"), ("keywords", "array<string>"))), F.lit("IDLE").alias("status"), F.lit(None).cast("string").alias("last_active"))


def write_registry(spark: SparkSession, path: str, cards: DataFrame) -> None:
    """Writes the registry file: one card for each project, by its id."""
    listed = cards.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*(x.split()[0] for x in CARD.split(", ")))))).alias("x")).first()["x"]
    put_text(spark, path, '{"projects": ' + (listed or "[]") + "}")


def synchronised(cards: DataFrame, *sources: DataFrame) -> DataFrame:
    """(project_id, known, sources): every project of the cards and of other
    sources (project_id, source), whether it has a card and who knows it."""
    every = cards.select("project_id", F.lit("registry").alias("source"))
    for source in sources:
        every = every.unionByName(source.select("project_id", "source"))
    return every.where("project_id <> ''").groupBy("project_id").agg(F.bool_or(F.col("source") == "registry").alias("known"), F.array_sort(F.collect_set("source")).alias("sources"))


def sync_report(found: DataFrame) -> DataFrame:
    """One row: projects, those without a card, and a list of these."""
    return found.agg(F.count(F.lit(1)).alias("projects"), F.count_if(~F.col("known")).alias("without_card"), F.array_sort(F.collect_list(F.when(~F.col("known"), F.col("project_id")))).alias("x")).select("projects", "without_card", bullets(F.col("x"), "none").alias("listed"))
