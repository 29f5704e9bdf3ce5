"""The page store kept by Structured Streaming: each micro-batch of commands is folded onto the states before it.

A CLEAN concerns all pages, so state is a table and not keyed state: a batch reads the version before it and writes its own.
A batch that is tried again overwrites its own version, so commands count once. Commands that are not newer than the last
batch of all are late: they are dropped, as replays are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagfold.operators import pages
from tagfold.sources.snapshots import saved, shared_folder


def followed(log: DataFrame, always: bool = True) -> DataFrame:
    """Runs a streaming page log (pages.COLUMNS) to its end and returns pages.STATE of all pages."""
    spark = log.sparkSession
    base = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    version = lambda n: f"{base}/states/n={n}"
    last: dict[int, int | None] = {-1: None}

    def follow(df: DataFrame, n: int) -> None:
        rows = df.persist()
        before = spark.read.schema(pages.STATE).parquet(version(n - 1)) if n else None
        seen = last.get(n - 1)
        if seen is not None:
            rows = rows.where(F.col("seq") > seen)
        top = rows.agg(F.max("seq")).first()[0]
        pages.states(rows, saved(spark, "pages"), before, always=always).write.mode("overwrite").parquet(version(n))
        last[n] = seen if top is None else top
        df.unpersist()

    query = log.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(follow).start()
    query.awaitTermination()
    newest = max(last)
    return spark.read.schema(pages.STATE).parquet(version(newest)) if newest >= 0 else spark.createDataFrame([], pages.STATE)
