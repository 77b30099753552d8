"""Joins on nearly equal texts, by an index of segments.

A text that is turned into another by d edits keeps one of any d + 1 disjoint
segments whole.  Cut from the left, one kept segment i (from 0) is moved by i
places at most: the first i for which the edits up to its end number i or fewer
has none in itself and i before it.  So texts of one side are indexed by their
segments, and those of the other side look up the substrings around each place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_engine.functions.text import nearly_same, normalize_text
from recall_engine.operators.ranges import settled

#: Segments of a text at most (a look-up takes their square), and characters of
#: one at least; texts beyond either meet by the band of their length alone.
MOST_SEGMENTS, LEAST_WIDTH = 20, 2
#: Keys of up to so many different texts on the right don't use segments: there
#: comparing the texts of a band costs less than looking segments up.
SMALL_KEY = 100


def band_of(length: int, least: float) -> int:
    return math.floor(math.log(max(length, 1)) / -math.log(least) + 1e-9)


def _band(text: str, least: float) -> Column:
    """Bands of lengths: each is 1 / least as long as the one before."""
    return F.floor(F.log(F.greatest(F.length(text), F.lit(1))) / -math.log(least) + 1e-9).cast("int")


def segment_plan(least: float) -> list[tuple[int, int]]:
    """(segments, width) of the texts of each band, as far as there are segments.

    The band's longest text and the longest one that can be as similar to it say
    how many edits there are at most; its shortest text must hold one segment more.
    """
    plan, length, band = [], 0, 0
    while True:
        low = length
        while band_of(length, least) == band:
            length += 1
        most = math.floor((1 - least) * math.floor((length - 1) / least + 1e-9) + 1e-9)
        if most + 1 > MOST_SEGMENTS or band > 200:
            return plan
        width = low // (most + 1)
        plan.append((most + 1, width) if width >= LEAST_WIDTH else (0, 0))
        band += 1


def similar_texts(left: DataFrame, right: DataFrame, on: Sequence[str], least: float) -> DataFrame:
    """(*on, a, b): pairs of the texts ``a`` of left (*on, a) and ``b`` of right
    (*on, b) of equal keys that are as similar as ``least``, each pair once.

    Texts are normalised and different within a key; null keys meet nothing.
    From 1 on only equal texts meet, above it none, at 0 and below all.  A pair
    is met at the first segment that it shares, and so once.
    """
    on = list(on)
    if least > 1:
        return left.join(right, on).where(F.lit(False)).select(*on, "a", "b")
    if least == 1:
        return left.join(right.withColumn("_b", F.col("b")), [*[left[c] == right[c] for c in on], F.col("a") == F.col("_b")]).select(*[left[c] for c in on], "a", F.col("_b").alias("b"))
    if least <= 0:
        return left.join(right, on).select(*on, "a", "b")
    return candidate_texts(left, right, on, least).where(nearly_same(F.col("a"), F.col("b"), least))


def candidate_texts(left: DataFrame, right: DataFrame, on: Sequence[str], least: float) -> DataFrame:
    """(*on, a, b): the pairs that similar_texts verifies for 0 < least < 1."""
    on = list(on)
    plan = segment_plan(least) or [(0, 0)]
    at = lambda i: lambda band: F.coalesce(F.try_element_at(F.array(*(F.lit(p[i]) for p in plan)), band + 1), F.lit(0))
    segments, width = at(0), at(1)
    empty = F.array().cast("array<struct<i:int,s:string>>")

    def around(i: Column, w: Column) -> tuple[Column, Column]:
        """First and last place in ``a`` where segment i may be."""
        return F.greatest(F.lit(0), i * w - i), F.least(F.length("a") - w, i * w + i)

    def looked_up(i: Column) -> Column:
        first, last = around(i, F.col("_w"))
        found = F.array_distinct(F.transform(F.sequence(first, last), lambda p: F.substring(F.col("a"), p + 1, F.col("_w"))))
        return F.when(first > last, empty).otherwise(F.transform(found, lambda s: F.struct(i.cast("int").alias("i"), s.alias("s"))))

    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("s")))
    numbers = F.sequence(F.lit(0), F.col("_n") - 1)
    # both sides know from the same count whether a key is cut into segments
    sizes = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
    left, right = left.join(sizes, on), right.join(sizes, on)
    cut_up = F.col("_size") > SMALL_KEY
    place = _band("a", least)
    asked = left.select(*on, "a", "_size", F.explode(F.array(place - 1, place, place + 1)).alias("_band")).where("_band >= 0").withColumns({"_n": F.when(cut_up, segments(F.col("_band"))).otherwise(0), "_w": width(F.col("_band"))})
    asked = asked.select(*on, "a", "_band", "_n", "_w", F.explode(F.when(F.col("_n") == 0, whole).otherwise(F.flatten(F.transform(numbers, looked_up)))).alias("_x"))
    asked = asked.select(*on, "a", "_band", "_w", "_x.i", "_x.s")
    held = right.select(*on, "b", "_size", _band("b", least).alias("_band")).withColumns({"_n": F.when(cut_up, segments(F.col("_band"))).otherwise(0), "_w": width(F.col("_band"))})
    cut = F.transform(numbers, lambda i: F.struct(i.cast("int").alias("i"), F.substring(F.col("b"), i * F.col("_w") + 1, F.col("_w")).alias("s")))
    held = held.select(*on, "b", "_band", F.explode(F.when(F.col("_n") == 0, whole).otherwise(cut)).alias("_x")).select(*on, "b", "_band", "_x.i", "_x.s")

    def shares(j: Column) -> Column:
        """Whether segment j would have brought the pair together."""
        first, last = around(j, F.col("_w"))
        return (first <= last) & F.contains(F.substring(F.col("a"), first + 1, last - first + F.col("_w")), F.substring(F.col("b"), j * F.col("_w") + 1, F.col("_w")))

    again = F.when(F.col("i") > 0, F.exists(F.sequence(F.lit(0), F.col("i") - 1), shares)).otherwise(False)
    met = asked.join(held, [*on, "_band", "i", "s"])
    return met.where(~again).select(*on, "a", "b")


def _tidy(name: str) -> Column:
    return normalize_text(F.coalesce(F.col(name), F.lit("")))


def fuzzy_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], text: Sequence[str], least: Sequence[float]) -> DataFrame:
    """Pairs of rows of equal keys ``on`` of which one text at least is nearly
    the same on both sides, as similar as ``least`` says for it.

    The other columns of both sides must differ in name.  Different texts meet
    once, by similar_texts, whatever the number of rows that have them; a null
    text counts as empty.  A pair that meets by several texts comes once for
    each.
    """
    pairs = None
    for name, line in zip(text, least, strict=True):
        a = left.withColumn("a", _tidy(name)).drop(*text)
        b = right.withColumn("b", _tidy(name)).drop(*text)
        alike = similar_texts(a.select(*on, "a").distinct(), b.select(*on, "b").distinct(), on, line)
        found = a.join(alike, [*on, "a"]).join(b, [*on, "b"]).drop("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def last_alike(left: DataFrame, right: DataFrame, on: Sequence[str], text: Sequence[str], least: Sequence[float], last: Column) -> DataFrame:
    """left with ``last``: the largest such value of the rows of right of equal
    keys of which one text at least is as similar as ``least`` says for it; null
    where there is none.

    Rows of right are brought down to one for each text before texts meet, so
    that many rows of one text cost no more than one.
    """
    out = left.withColumn("last", F.lit(None))
    for k, (name, line) in enumerate(zip(text, least, strict=True)):
        newest = right.withColumn("b", _tidy(name)).groupBy(*on, "b").agg(F.max(last).alias("_last"))
        mine = left.select(*on, _tidy(name).alias("a")).distinct()
        alike = similar_texts(mine, newest.select(*on, "b"), on, line).join(newest, [*on, "b"]).groupBy(*on, "a").agg(F.max("_last").alias("_last"))
        out = out.withColumn("a", _tidy(name)).join(alike, [*on, "a"], "left").withColumn("last", F.greatest("last", "_last") if k else F.col("_last")).drop("a", "_last")
    return out


def best_match(targets: DataFrame, candidates: DataFrame, on: Sequence[str], target: str, text: str, order: str, least: float = 0.7, lines: Sequence[float] = (0.95, 0.85)) -> DataFrame:
    """targets with ``match`` (order, text, score) of the most similar candidate
    of equal keys ``on``, the first by ``order`` of equal ones; null where none
    is as similar as ``least`` or the target is empty.

    Texts are compared at falling thresholds, ``lines`` and then ``least``: the
    first one that a target finds anything at holds its best match, and only
    targets without any go on to the next, which looks up more.
    """
    on = list(on)
    held = candidates.select(*on, _tidy(text).alias("b"), F.col(order).alias("_order"), F.col(text).alias("_text")).groupBy(*on, "b").agg(F.min(F.struct("_order", "_text")).alias("_first"))
    open_ = targets.where(F.col(target) != "").select(*on, _tidy(target).alias("a")).distinct()
    best = None
    for line in [*(x for x in lines if x > least), least]:
        longest = F.greatest(F.length("a"), F.length("b"))
        score = F.when(longest == 0, F.lit(1.0)).when(F.least(F.length("a"), F.length("b")) == 0, F.lit(0.0)).otherwise(1 - F.levenshtein("a", "b") / longest)
        alike = similar_texts(open_, held.select(*on, "b"), on, line).withColumn("_score", score).where(F.col("_score") >= line)
        # the best score is settled on texts; only then do their rows come in
        found = alike.join(held, [*on, "b"]).groupBy(*on, "a").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col("_first._order").alias("o"), F.col("_first._text").alias("t"))).alias("x"))
        if line > least:
            found = settled(found)  # read by this round's answer and the next round's question
        best = found if best is None else best.unionByName(found)
        open_ = open_.join(found, [*on, "a"], "left_anti")
    match = best.select(*on, "a", F.struct(F.col("x.o").alias("order"), F.col("x.t").alias("text"), (-F.col("x.s")).alias("score")).alias("match"))
    return targets.withColumn("a", F.when(F.col(target) != "", _tidy(target))).join(match, [*on, "a"], "left").drop("a")
