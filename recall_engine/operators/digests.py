"""Fingerprints of sets that can be added to and taken from.

An item counts as the two 64-bit halves of its md5; a set's digest is the count
and the sums of both.  Partial aggregation adds them in any order, and a change
costs what changed: the digests of what came and went, not the whole set.  They
tell changes apart by chance, not against someone who builds a set to match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LANES = ("low", "high")


def _halves(item: Column) -> list[Column]:
    digest = F.md5(item)
    return [F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]


def set_digest(rows: DataFrame, by: Sequence[str], item: Column) -> DataFrame:
    """(*by, n, low, high) of the items of each key, equal ones counted each.  A
    null item isn't in the set; a key without items has no row."""
    halves = rows.select(*by, *(x.alias(name) for x, name in zip(_halves(item), _LANES, strict=True))).where("low IS NOT NULL")
    return halves.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(x).cast("decimal(38,0)").alias(x) for x in _LANES))


def updated_digest(digests: DataFrame, by: Sequence[str], came: DataFrame, went: DataFrame) -> DataFrame:
    """Digests of keys after items came and others went, both as digests; keys of
    which nothing is left leave."""
    signed = lambda df, sign: df.select(*by, *((F.col(c) * sign).cast("decimal(38,0)").alias(c) for c in ("n", *_LANES)))
    whole = signed(digests, 1).unionByName(signed(came, 1)).unionByName(signed(went, -1))
    summed = whole.groupBy(*by).agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("n", *_LANES)))
    return summed.where("n <> 0").withColumn("n", F.col("n").cast("long"))


def digest_text() -> Column:
    """A digest's columns as one text."""
    return F.concat_ws(":", F.col("n").cast("string"), *(F.col(x).cast("string") for x in _LANES))


def changed_keys(digests: DataFrame, stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by): keys whose digest is new or another one than the stored one; what
    has to be generated again."""
    return digests.select(*by, digest_text().alias("digest")).join(stored.select(*by, digest_text().alias("digest")), [*by, "digest"], "left_anti").select(*by)
