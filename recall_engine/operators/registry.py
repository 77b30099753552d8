"""Project cards: merging registrations, card texts, discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.operators.embedding import Embedder, embed_with_cache
from recall_engine.operators.vectors import top_k


def merge_cards(log: DataFrame, key: str, fields: Sequence[str], order: Column) -> DataFrame:
    """One card per key: of each field the latest value that isn't null or empty
    (a list without elements counts as empty)."""

    def filled(c: str) -> Column:
        kind = log.schema[c].dataType.typeName()
        return F.size(c) > 0 if kind == "array" else F.col(c).cast("string") != ""

    return log.groupBy(key).agg(*(F.max_by(F.when(filled(c), F.col(c)), F.when(filled(c), order)).alias(c) for c in fields))


def card_text(labels: dict[str, str]) -> Column:
    """The labelled lines that stand for a card when it is embedded; null fields give none."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for c, label in labels.items()))


def project_text() -> Column:
    """What is embedded of a card (project_id, description, keywords,
    responsibilities, owns, project_type, exports): the first three always, the
    others where they aren't null or empty."""
    joined = lambda c, sep: F.array_join(F.col(c), sep)
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    some = lambda label, value: F.when(value != "", line(label, value))
    return F.concat_ws(
        "\n",
        line("Project", F.col("project_id")),
        line("Description", F.coalesce("description", F.lit(""))),
        line("Keywords", F.coalesce(joined("keywords", ", "), F.lit(""))),
        some("Responsibilities", joined("responsibilities", ". ")),
        some("Owns", joined("owns", ", ")),
        some("Type", F.col("project_type")),
        some("Exports", F.col("exports")),
    )


def embed_cards(cards: DataFrame, cache: DataFrame, model: str, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(cards with ``content`` and ``vector``, rows to add to the cache): only
    cards whose text changed since the cache saw them are embedded, many at once
    where they lie."""
    return embed_with_cache(cards.withColumns({"id": F.col("project_id"), "content": project_text()}), cache, model, embedder)


def register_projects(cards: DataFrame, log: DataFrame, cache: DataFrame, model: str, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(all cards with vectors, rows to add to the cache) after registrations.

    cards and log have the columns of project_text and ``path``, log a time
    ``ts`` as well.  What a registration leaves null or empty stays as it was;
    a registered project is active since its latest registration."""
    fields = ["description", "keywords", "responsibilities", "owns", "project_type", "exports", "path"]
    before = cards.select("project_id", *fields, F.col("last_active").alias("ts"), F.lit(0).alias("_new"))
    both = before.unionByName(log.select("project_id", *fields, "ts", F.lit(1).alias("_new")))
    merged = merge_cards(both, "project_id", fields, F.struct("_new", "ts"))
    times = both.groupBy("project_id").agg(F.max("ts").alias("last_active"))
    return embed_cards(merged.join(times, "project_id"), cache, model, embedder)


def matches_text(columns: Sequence[str], wanted: str) -> Column:
    """Whether any of the columns (texts or lists of texts) holds a text, whatever its case."""
    low = wanted.lower()
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(low)), F.lit(False))
    return found


def ranked_cards(vectors: DataFrame, query: Sequence[float], cards: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The cards of the k nearest vectors with their rank; hits without a card go.
    The k ranked hits are a bounded side."""
    hits = top_k(vectors, query, k)
    listed = hits.agg(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))).alias("hits")).select(F.posexplode("hits").alias("at", "hit"))
    ranked = listed.select((F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias(key), (1 - F.col("hit.distance")).alias("score"))
    return cards.join(F.broadcast(ranked), key)


def discover(cards: DataFrame, columns: Sequence[str], wanted: str, ranked: DataFrame | None) -> DataFrame:
    """Ranked cards if there are any, else those that hold the text; all for a
    blank text.  Only the emptiness of the ranked side is looked at."""
    if not wanted.strip():
        return cards
    if ranked is not None and not ranked.isEmpty():
        return ranked
    return cards.where(matches_text(columns, wanted))
