"""The session store as a fold of its command log.

A read of an expired session deletes it, which restarts its write count, so state depends on state and commands are folded
in order. But a DESTROY ends what came before: a session's lives, from one DESTROY to the next, are folded apart, wherever
they lie, so a session with any share of all commands is no single task's work. Partitions are sorted by life and sequence
number and folded as they stream past, with one state in memory at a time; a session then has the state of its last life.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagfold.functions import lifetimes as L
from tagfold.operators.eviction import before
from tagfold.ship import ship

STATE = "id string, ua int, num_writes long, mtime long, expire long, lru_seq long, reads long, hits long, alive boolean"


class Session:
    """State of one session; apply() follows one command."""

    __slots__ = ("alive", "ua", "num_writes", "mtime", "expire", "lru_seq", "reads", "hits")

    def __init__(self) -> None:
        self.reads = self.hits = 0
        self.drop()

    def drop(self) -> None:
        self.alive, self.ua, self.num_writes, self.mtime, self.expire, self.lru_seq = False, 0, 0, 0, 0, 0

    def apply(self, seq: int, ts: int, ua: int, op: str, lifetime: int | None, revive: bool = False, always: bool = False) -> None:
        """revive: a read brings an expired session back, as documented; else it deletes it, as servers do.

        always: every read lengthens the lifetime (LRU modes), else only that of an expired session.
        """
        if op == "DESTROY":
            self.drop()
        elif op == "READ":
            self.reads += 1
            if self.alive and self.expire < ts and not revive:
                self.drop()
            if self.alive:
                self.hits += 1
                self.ua, self.lru_seq = max(self.ua, ua), seq
                if self.num_writes > 0 and (always or ts >= self.expire):
                    self.expire = max(self.expire, ts + L.SESSION_READ_EXTRA[self.ua])
        elif op != "WRITE":
            raise ValueError(f"the session fold has no rule for {op}")
        else:
            self.alive, self.ua, self.mtime, self.lru_seq = True, max(self.ua, ua), ts, seq
            if self.ua == L.USER and lifetime is not None and lifetime >= 0 and lifetime != L.INFINITE:
                self.expire = L.INFINITE if lifetime == 0 else min(ts + lifetime, L.INFINITE - 1)
                return
            n, most, first, default = self.num_writes, max(L.SESSION_FIRST_WRITES[self.ua], 1), L.SESSION_FIRST[self.ua], L.SESSION_DEFAULT[self.ua]
            self.expire = ts + (first if n == 0 else first + (max(default, first) - first) * n // most if n < most else default)
            self.num_writes = n + 1

    def row(self, name: str) -> tuple:
        return name, self.ua, self.num_writes, self.mtime, self.expire, self.lru_seq, self.reads, self.hits, self.alive


def lives(log: DataFrame, ends: Column) -> DataFrame:
    """log with life: how many commands of the session that meet ends came before. In two steps, so no task counts a whole session."""
    counted = before(log.withColumn("lru_seq", F.col("seq")), ["id"], F.coalesce(ends, F.lit(False)).cast("long"), "life")
    return counted.drop("lru_seq")


def fold(log: DataFrame, revive: bool = False, always: bool = False) -> DataFrame:
    """STATE of each session of the log (seq, ts, id, ua, op, lifetime) after its last command."""
    ship(log.sparkSession)
    names = [x.split()[0] for x in STATE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Session()
        for b in batches:
            done = []
            lifetimes = b["lifetime"].astype(object).where(b["lifetime"].notna(), None)
            for name, life, seq, ts, ua, op, lifetime in zip(b["id"], b["life"], b["seq"], b["ts"], b["ua"], b["op"], lifetimes):
                if (name, life) != current:
                    if current is not None:
                        done.append((*state.row(current[0]), current[1]))
                    current, state = (name, life), Session()
                state.apply(seq, ts, ua, op, None if lifetime is None else int(lifetime), revive, always)
            yield pd.DataFrame(done, columns=[*names, "life"])
        if current is not None:
            yield pd.DataFrame([(*state.row(current[0]), current[1])], columns=[*names, "life"])

    rows = lives(log.select("id", "seq", "ts", "ua", "op", "lifetime"), F.col("op") == "DESTROY").repartition("id", "life").sortWithinPartitions("id", "life", "seq")
    each = rows.mapInPandas(run, f"{STATE}, life long")
    last = [n for n in names if n not in ("id", "reads", "hits")]
    whole = each.groupBy("id").agg(F.max_by(F.struct(*last), "life").alias("_last"), F.sum("reads").alias("reads"), F.sum("hits").alias("hits"))
    return whole.select(*(F.col(n) if n in ("id", "reads", "hits") else F.col(f"_last.{n}").alias(n) for n in names))


def live(log: DataFrame, revive: bool = False, always: bool = False) -> DataFrame:
    return fold(log, revive, always).where("alive").select("id", "ua", "num_writes", "mtime", "expire", "lru_seq")


def hits_and_misses(log: DataFrame) -> DataFrame:
    return fold(log).select("id", "reads", "hits", (F.col("reads") - F.col("hits")).alias("misses"))


def write_lifetimes(log: DataFrame) -> DataFrame:
    """Lifetime of each write by its number since the session's last DESTROY: the progressive rule without reads."""
    w = lives(log, F.col("op") == "DESTROY").where("op = 'WRITE'")
    asked = (F.col("ua") == L.USER) & (F.col("lifetime") >= 0)
    n = F.sum((~F.coalesce(asked, F.lit(False))).cast("long")).over(Window.partitionBy("id", "life").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("num_writes", F.coalesce(n, F.lit(0)))
    grown = F.col("ts") + L.session_lifetime(F.col("ua"), F.col("lifetime"), F.col("num_writes"))
    own = F.when(F.col("lifetime") == 0, F.lit(L.INFINITE).cast("long")).otherwise(F.least(F.col("ts") + F.col("lifetime"), F.lit(L.INFINITE - 1)))
    return w.select("seq", "id", "num_writes", F.when(F.coalesce(asked, F.lit(False)), own).otherwise(grown).alias("expire"))


def promoted(log: DataFrame) -> DataFrame:
    """User-agent class of each session after each command: the greatest seen since its last DESTROY."""
    rows = lives(log, F.col("op") == "DESTROY").where("op != 'DESTROY'")
    return rows.select("seq", "id", F.max("ua").over(Window.partitionBy("id", "life").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).alias("record_ua"))


def lock_conflicts(log: DataFrame, wait: int = 8) -> DataFrame:
    """Reads that wait for a lock: another read of the session took it at most wait seconds before, and no write or destroy came since.

    Reads between the same two other commands are dealt to buckets of wait seconds, so they only meet those near them in time.
    """
    reads = lives(log, F.col("op") != "READ").where("op = 'READ'").withColumn("_b", F.floor(F.col("ts") / wait))
    a = reads.select("id", "life", F.col("seq").alias("holder"), F.col("ts").alias("_from"), F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"))
    b = reads.select("id", "life", "_b", F.col("seq").alias("waiter"), F.col("ts").alias("_ts"))
    near = (F.col("waiter") > F.col("holder")) & (F.col("_ts") - F.col("_from") <= wait)
    return a.join(b, ["id", "life", "_b"]).where(near).select("id", "holder", "waiter")


def lock_waits(log: DataFrame, wait: int = 8) -> DataFrame:
    """Reads that find the session locked for another request: id, holder, waiter, waited (seconds) and broken.

    The first read of a request locks the session for its request_id, until the request's next write or any destroy. A read
    of another request waits for that, wait seconds at most: then it breaks the lock. A lock that nothing has released is
    taken for broken wait seconds after it was taken, so both sides are dealt to buckets of that time.
    """
    later = Window.partitionBy("id", "request_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    end = F.struct("seq", "ts")
    marked = lives(log, F.col("op") == "DESTROY").withColumns({
        "_own": F.min(F.when(F.col("op") == "WRITE", end)).over(later),
        # the destroy that ends a life is its last command
        "_any": F.max(F.when(F.col("op") == "DESTROY", end)).over(Window.partitionBy("id", "life")),
        "_first": F.row_number().over(Window.partitionBy("id", "request_id", "op").orderBy("seq")),
    })
    reads = marked.where("op = 'READ'").withColumns({"_end": F.least("_own", "_any"), "_b": F.floor(F.col("ts") / wait)})
    a = reads.where("_first = 1").select("id", F.col("seq").alias("holder"), F.col("request_id").alias("_request"), F.col("ts").alias("_from"), "_end", F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"))
    b = reads.select("id", "_b", F.col("seq").alias("waiter"), "request_id", F.col("ts").alias("_ts"))
    held = (F.col("waiter") > F.col("holder")) & (F.col("request_id") != F.col("_request")) & (F.col("_ts") - F.col("_from") <= wait) & (F.col("_end").isNull() | (F.col("waiter") < F.col("_end.seq")))
    left = F.col("_end.ts") - F.col("_ts")
    broken = left.isNull() | (left > wait)
    return a.join(b, ["id", "_b"]).where(held).select("id", "holder", "waiter", F.when(broken, wait).otherwise(left).cast("long").alias("waited"), broken.alias("broken"))
