"""The session store kept by Structured Streaming: keyed state that follows each micro-batch of commands."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagfold.operators.sessions import STATE, Session
from tagfold.ship import ship
from tagfold.sources import snapshots
from tagfold.sources.snapshots import shared_folder

KEPT = "ua int, num_writes long, mtime long, expire long, lru_seq long, reads long, hits long, alive boolean, last_seq long"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Commands of one micro-batch come in any order, so they are sorted; a session's state follows them.

    Late ones, not newer than what an earlier batch has applied to the session, are dropped: so are replays.
    """
    s, seen = Session(), -(1 << 62)
    if state.exists:
        s.ua, s.num_writes, s.mtime, s.expire, s.lru_seq, s.reads, s.hits, s.alive, seen = state.get
    rows = pd.concat(list(batches)).sort_values("seq")
    rows = rows[rows["seq"] > seen]
    if not len(rows):
        return
    lifetimes = rows["lifetime"].astype(object).where(rows["lifetime"].notna(), None)
    for seq, ts, ua, op, lifetime in zip(rows["seq"], rows["ts"], rows["ua"], rows["op"], lifetimes):
        s.apply(int(seq), int(ts), int(ua), op, None if lifetime is None else int(lifetime))
    row = tuple(int(x) if not isinstance(x, bool) else x for x in s.row("")[1:])
    last = int(rows["seq"].max())
    state.update((*row, last))
    yield pd.DataFrame([(key[0], *row, last)], columns=[x.split()[0] for x in f"{STATE}, last_seq long".split(", ")])


def changes(log: DataFrame) -> DataFrame:
    """A streaming log (seq, ts, id, ua, op, lifetime) to the sessions' states after each micro-batch, with last_seq."""
    ship(log.sparkSession)
    columns = log.select("id", "seq", "ts", "ua", "op", "lifetime")
    return columns.groupBy("id").applyInPandasWithState(_follow, f"{STATE}, last_seq long", KEPT, "update", GroupStateTimeout.NoTimeout)


def drain(log: DataFrame) -> DataFrame:
    """Runs a streaming log to its end and returns the states of all sessions, folder and checkpoint in the shared folder."""
    spark = log.sparkSession
    base = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    query = (
        changes(log).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/states/batch={n}")).start()
    )
    query.awaitTermination()
    last = Window.partitionBy("id").orderBy(F.desc("last_seq"))
    return spark.read.parquet(f"{base}/states").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch", "last_seq")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern, since a stream's plain path has to be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")


def windowed_counts(log: DataFrame, width: str = "1 day") -> DataFrame:
    """Commands by operation in event-time windows, however late they come: all counts stay as state, windows x operations of them."""
    at = log.withColumn("at", F.timestamp_seconds("ts"))
    return at.groupBy(F.window("at", width).alias("w"), "op").agg(F.count("*").alias("num"))


def fan_out(log: DataFrame, paths: list[str], checkpoint: str) -> None:
    """Sends a streaming log's mutating commands to each of paths (replicas, a binlog), a folder per micro-batch.

    A batch that is tried again overwrites its own folder, so each command arrives once.
    """

    def send(df: DataFrame, n: int) -> None:
        rows = snapshots.replicated(df).persist()
        for p in paths:
            rows.write.mode("overwrite").parquet(f"{p}/batch={n}")
        rows.unpersist()

    log.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(send).start().awaitTermination()


def counted(log: DataFrame, width: str = "1 day") -> DataFrame:
    """windowed_counts() of a whole stream: day (epoch seconds of the window's start), op, num."""
    spark = log.sparkSession
    base = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    query = (
        windowed_counts(log, width).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/n={n}")).start()
    )
    query.awaitTermination()
    last = Window.partitionBy("w", "op").orderBy(F.desc("_batch"))
    rows = spark.read.parquet(f"{base}/out").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.select(F.unix_timestamp("w.start").alias("day"), "op", "num")
