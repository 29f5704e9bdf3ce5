"""Queries by tag and by id on page records. Tags are sets; an empty query list matches nothing, or excludes nothing.

A null list of tags has none, and null tags in a list are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNTAGGED = "<<< UNTAGGED >>>"


def asked(tags: list[str]) -> Column:
    return F.array_distinct(F.array(*map(F.lit, tags))) if tags else F.array().cast("array<string>")


def own(tags: Column) -> Column:
    """The tags of a record."""
    return F.coalesce(F.array_compact(tags), F.array().cast("array<string>"))


def linked(tags: Column) -> Column:
    """The tags a record is found by: one without tags by a reserved one."""
    return F.when(F.size(own(tags)) == 0, F.array(F.lit(UNTAGGED))).otherwise(own(tags))


def has_all(tags: list[str]) -> Column:
    q = asked(tags)
    return (F.size(F.array_intersect(linked(F.col("tags")), q)) == F.size(q)) & (F.size(q) > 0)


def has_any(tags: list[str]) -> Column:
    return F.arrays_overlap(linked(F.col("tags")), asked(tags))


def has_at_least(tags: list[str], n: int) -> Column:
    return F.size(F.array_intersect(linked(F.col("tags")), asked(tags))) >= n


def ids(fpc: DataFrame) -> DataFrame:
    return fpc.select("id")


def matching(fpc: DataFrame, tags: list[str]) -> DataFrame:
    return fpc.where(has_all(tags)).select("id")


def not_matching(fpc: DataFrame, tags: list[str]) -> DataFrame:
    return fpc.where(~has_any(tags)).select("id")


def matching_any(fpc: DataFrame, tags: list[str]) -> DataFrame:
    return fpc.where(has_any(tags)).select("id")


def matching_at_least(fpc: DataFrame, tags: list[str], n: int) -> DataFrame:
    return fpc.where(has_at_least(tags, n)).select("id")


def tags(fpc: DataFrame) -> DataFrame:
    return fpc.select(F.explode(own(F.col("tags"))).alias("tag")).distinct()


def tag_counts(fpc: DataFrame) -> DataFrame:
    return fpc.select(F.explode(linked(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("num"))


def rarest(fpc: DataFrame, wanted: list[str]) -> DataFrame:
    """Of the wanted tags that exist the one with the fewest records, ties to the first by name."""
    return tag_counts(fpc).where(F.col("tag").isin(wanted)).orderBy("num", "tag").limit(1)


def untagged(fpc: DataFrame) -> DataFrame:
    return fpc.where(F.size(own(F.col("tags"))) == 0).select("id")


def metadatas(fpc: DataFrame, names: list[str]) -> DataFrame:
    return fpc.where(F.col("id").isin(names)).select("id", "expire", "mtime", F.array_join(F.array_sort(own(F.col("tags"))), ",").alias("tag_list"))


def survivors(fpc: DataFrame, mode: str, tags: list[str], now: int) -> DataFrame:
    """Ids that a CLEAN leaves. mode: all, old, matchall, matchnot or matchany."""
    gone = {"all": F.lit(True), "old": F.coalesce(F.col("expire") < now, F.lit(False)), "matchall": has_all(tags), "matchnot": ~has_any(tags), "matchany": has_any(tags)}[mode]
    return fpc.where(~gone).select("id")


def added(tags: Column, more: list[str]) -> Column:
    """A tag list with more tags, each once, in the order of their first mention."""
    return F.array_union(own(tags), asked(more))


def removed(tags: Column, less: list[str]) -> Column:
    return F.array_except(own(tags), asked(less))
