"""URL sets for cache warming: filter, union, order and page them; plan and sum up passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*sources: DataFrame) -> DataFrame:
    """url once each: at its first place, with its last priority. Sources have url, priority_milli, lastmod, ord."""
    rows = sources[0].withColumn("_s", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.withColumn("_s", F.lit(i)))
    place = F.struct("_s", "ord")
    return rows.groupBy("url").agg(F.max_by("priority_milli", place).alias("priority_milli"), F.max_by("lastmod", place).alias("lastmod"), F.min(place).alias("_first"))


#: Orders of a list of URLs: by priority, the best or the worst first, or as they came; ties as they came.
ORDERS = {"desc": ("-priority_milli", "ord"), "asc": ("priority_milli", "ord"), "as-is": ("ord",)}


def page(urls: DataFrame, low: int, high: int, cutoff: int, begin: int, number: int, order: str = "desc") -> DataFrame:
    """URLs with a priority in the range and a modification at cutoff or later, in one of ORDERS, from begin on; number 0: all."""
    chosen = urls.where(F.col("priority_milli").between(low, high) & (F.col("lastmod") >= cutoff)).orderBy(*(F.expr(x) for x in ORDERS[order])).offset(begin)
    return chosen.limit(number) if number else chosen


def passes(urls: DataFrame, n_passes: int, workers: int) -> DataFrame:
    """A row for each pass and URL with the worker that loads it, in turn."""
    return urls.select("url", F.col("ord"), F.explode(F.sequence(F.lit(1), F.lit(n_passes))).alias("pass")).withColumn("worker", F.col("ord") % workers)


def pass_stats(timings: DataFrame) -> DataFrame:
    """pass, pages, total_ms and the whole milliseconds of a page on average."""
    return timings.groupBy("pass").agg(F.count("*").alias("pages"), F.sum("ms").alias("total_ms")).withColumn("avg_ms", F.expr("total_ms div pages"))
