"""Secret scans with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_engine.llm.stage import NULL_ID, keyed, public_id, row_key, written

#: (kind, pattern, least length, group whose length counts).  Base kinds first,
#: in the order in which spans of equal start are listed.
BASE = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
]
#: Weak kinds: too common to report alone.
WEAK = [
    ("key_part", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 40, 0),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/?#&=%+-]*)?", 11, 0),
]


@dataclass(frozen=True)
class Linking:
    """Parts belong together within ``scope`` code points of each other."""

    scope: int = 300


def _fast(pattern: str, least: int, group: int) -> str:
    """A cheaper pattern that finds a match in the same texts or more."""
    return pattern[:-1] + f"{{{least - 4 if pattern.startswith('AKIA') else least},}}" if group == 0 and pattern.endswith("]+") else pattern


def find_spans(rows: DataFrame, kinds=(*BASE, *WEAK)) -> DataFrame:
    """(key, id, kind, rank, start, end) of the matches in whole texts, places
    in code points, end exclusive.

    Spark's functions give matches, not their places: a match starts after the
    gaps and matches before it, and both come from cutting the text by the
    pattern.  Matches that fail the least length take their place and go.
    """
    found = F.array(
        *(
            F.when(
                F.col("text").rlike(_fast(pattern, least, group)),
                F.struct(F.lit(i).alias("rank"), F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits")),
            )
            for i, (_, pattern, least, group) in enumerate(kinds)
        )
    )
    each = rows.select("key", "id", F.explode(F.array_compact(found)).alias("f")).select("key", "id", "f.rank", F.posexplode(F.arrays_zip("f.gaps", "f.hits")).alias("place", "part"))
    size = each.select("key", "id", "rank", "place", F.length("part.gaps").alias("gap"), F.col("part.hits").alias("hit")).where(F.col("hit").isNotNull())
    # rows of equal id and text share their spans
    once = size.dropDuplicates(["key", "id", "rank", "place"])
    order = Window.partitionBy("key", "id", "rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = once.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(order))
    long_enough = F.lit(False)
    kind = F.lit(None).cast("string")
    for i, (name, pattern, least, group) in enumerate(kinds):
        counted = F.length("hit") if group == 0 else F.length(F.regexp_extract("hit", pattern, group))
        long_enough = F.when(F.col("rank") == i, counted >= least).otherwise(long_enough)
        kind = F.when(F.col("rank") == i, F.lit(name)).otherwise(kind)
    return ends.where(long_enough).select("key", "id", kind.alias("kind"), "rank", (F.col("end") - F.length("hit")).alias("start"), "end")


def _near(weak: DataFrame, anchors: DataFrame, scope: int) -> DataFrame:
    """The weak spans with an anchor within ``scope`` code points: an interval
    join on scope-wide bins that keeps rows of the left side only.  Spans lie in
    every bin from start to end, and those met in several are kept once."""
    bins = anchors.select(F.col("key").alias("k"), F.col("id").alias("i"), F.col("start").alias("s"), F.col("end").alias("e")).withColumn(
        "bin", F.explode(F.sequence(F.floor((F.col("s") - scope) / scope), F.floor((F.col("e") + scope) / scope)))
    )
    left = weak.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    near = (F.col("start") <= F.col("e") + scope) & (F.col("end") >= F.col("s") - scope)
    return left.join(bins, (F.col("key") == F.col("k")) & (F.col("id") == F.col("i")) & (left["bin"] == bins["bin"]) & near, "left_semi").drop("bin").dropDuplicates(["key", "id", "rank", "start"])


def linked_spans(spans: DataFrame, linking: Linking = Linking()) -> DataFrame:
    """Base spans, and the weak ones whose complementary parts stand near, for
    rows of find_spans; without rows there are none.

    A bare 40-character key part counts near an access identifier; an endpoint
    counts near an access identifier and near a secret (an assigned value or a
    key part that counts).
    """
    of = lambda *names: spans.where(F.col("kind").isin(*names))
    base = of(*(k for k, *_ in BASE))
    parts = _near(of("key_part"), of("access"), linking.scope)
    secrets = of("assign").unionByName(parts)
    ends = _near(_near(of("endpoint"), of("access"), linking.scope), secrets, linking.scope)
    return base.unionByName(parts).unionByName(ends)


def scan_secrets(docs: DataFrame, linking: Linking = Linking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, found) for every row of docs, where
    found is an array of (start, rank, kind, end) by start and kind.

    Null text counts as empty: no spans.  Rows of equal id and text have equal
    results, null ids stay, an empty table gives no rows; other columns go.
    Spans of one document are gathered in its row, never those of many.
    """
    rows = keyed(docs, id_col, text_col)
    spans = linked_spans(written(find_spans(rows), "spans"), linking)
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k, *_ in BASE]
    found = spans.groupBy("key", "id").agg(*counts, F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return (
        rows.select("key", "id")
        .join(found, ["key", "id"], "left")
        .select(public_id().alias("doc_id"), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k, *_ in BASE), F.coalesce(F.col("found").cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"), none).alias("found"))
    )


def listed(found: str, base_only: bool = False):
    """kind:start:end of each span, comma-joined."""
    spans = F.filter(found, lambda x: x["rank"] < len(BASE)) if base_only else F.col(found)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, linking: Linking = Linking(), mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by ``mark``.

    Spans that overlap are replaced as one.  All rows and columns stay,
    whatever the columns are called; texts without spans, null and empty ones
    included, stay as they are; long ones are read whole; repeated rows are
    treated alike; an empty table gives an empty one.
    """
    # all columns travel as one, so that none can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"))
    spans = linked_spans(written(find_spans(keyed(docs, id_col, text_col)), "spans"), linking)
    per = Window.partitionBy("key", "id").orderBy("start", "end")
    before = per.rowsBetween(Window.unboundedPreceding, -1)
    run = F.sum(F.when(F.col("start") < F.coalesce(F.col("reach"), F.lit(-1)), 0).otherwise(1)).over(per.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.withColumn("reach", F.max("end").over(before)).withColumn("run", run).groupBy("key", "id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    # the kept stretches: from each span's end to the next one's start
    text = F.col("row")[text_col]
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda x: x["end"]))
    ends = F.concat(F.transform("cuts", lambda x: x["start"]), F.array(F.length(text).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(text, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    hidden = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(kept, mark))
    return rows.join(cuts, ["key", "id"], "left").select(*((hidden if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
