"""Who goes: garbage collection, memory quotas and emergencies, in least-recently-used order.

Records are ordered by user-agent class (the least valuable first) and then by last access. A class keeps at least its
retain count. Order and running sums go in two steps, so that no task ranks more than a bucket of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagfold.functions.lifetimes import by_ua

#: Records of a bucket of lru_seq, about: one task ranks those of a class in it.
PER_BUCKET = 1 << 14


def before(state: DataFrame, keys: list[str], value: Column, out: str, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds out: the sum of value over the rows of the same keys with a smaller lru_seq (ties: smaller id)."""
    span = state.agg(F.count("*").alias("n"), F.min("lru_seq").alias("low"), F.max("lru_seq").alias("high")).first()
    width = max(1, ((span["high"] or 0) - (span["low"] or 0) + 1) * per_bucket // max(span["n"], 1))
    s = state.withColumns({"_b": F.floor(F.col("lru_seq") / width), "_v": value})
    sums = s.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_b").orderBy("lru_seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    return s.join(base, [*keys, "_b"]).withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(within), F.lit(0))).drop("_b", "_v", "_base")


def collectable(state: DataFrame, victim: Column, retain: tuple[int, ...]) -> DataFrame:
    """The victims that a garbage collection deletes: of each class the oldest ones, as long as more than retain are left."""
    counts = state.groupBy("ua").agg(F.count("*").alias("_n"))
    marked = before(state.where(victim), ["ua"], F.lit(1).cast("long"), "_rank")
    return marked.join(counts, "ua").where(F.col("_rank") < F.col("_n") - by_ua(F.col("ua"), retain)).drop("_n", "_rank")


def collected(state: DataFrame, victim: Column, retain: tuple[int, ...], quota: int | None = None, mode: str = "expiration-lru") -> DataFrame:
    """Who goes in a garbage collection of an eviction mode: victims (in lru modes none), and in LRU order whoever else is
    above the quota then; strict-lru collects nothing."""
    if mode == "strict-lru":
        return state.where("false")
    may = collectable(state, victim, retain) if mode in ("expiration-lru", "strict-expiration-lru", "expiration") else state.where("false")
    if quota is None:
        return may
    # the walk deletes anything while above the quota, and only victims from then on
    above = evicted(state, F.col("total") - quota, retain)
    return above.unionByName(may.join(above.select("id"), "id", "left_anti").select(*state.columns))


def shrunk_domain(fpc_used: Column, fpc_quota: Column, session_used: Column, session_quota: Column) -> Column:
    """The domain that an emergency frees memory of: one above its quota (null: none), pages first, else the larger one."""
    over = lambda used, quota: F.coalesce(used > quota, F.lit(False))
    return F.when(over(fpc_used, fpc_quota), "fpc").when(over(session_used, session_quota), "session").when(fpc_used > session_used, "fpc").otherwise("session")


def evicted(state: DataFrame, excess: Column, retain: tuple[int, ...]) -> DataFrame:
    """Records deleted to free excess bytes: in order, until what is freed before a record reaches it. excess may use total (used bytes)."""
    total = state.agg(F.coalesce(F.sum("usize"), F.lit(0)).alias("total"))
    may = collectable(state, F.lit(True), retain)
    freed_of = may.groupBy("ua").agg(F.sum("usize").alias("_u"))
    classes = freed_of.select("ua", F.coalesce(F.sum("_u").over(Window.orderBy("ua").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_less"))
    ordered = before(may, ["ua"], F.col("usize"), "_in").join(classes, "ua").join(F.broadcast(total))
    return ordered.where(F.col("_less") + F.col("_in") < excess).select(*state.columns)
