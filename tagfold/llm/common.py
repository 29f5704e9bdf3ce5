"""What the training-data operators share: table access, shared scratch space and ranking in two steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagfold.ship import ship
from tagfold.sources.snapshots import new_folder

# Arrow's own pool keeps what it has freed; with the system's, a Python worker's memory shrinks again between batches
pa.set_memory_pool(pa.system_memory_pool())

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return new_folder(spark, f"tagfold-{what}")


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that later steps don't compute it anew.

    What it writes stays until the folder is cleaned: the DataFrames that are returned read it.

    The files outlive the loss of any executor, and the lineage ends there.
    """
    ship(df.sparkSession)
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sampled(df: DataFrame, at_most: int, *by: str, seed: int = 0) -> DataFrame:
    """The at_most rows with the smallest hashes of by, in that order; ties by by itself.

    Rows that can't be among them are left out first, by the number of all rows, so tasks don't send as many each.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 40))
    share = min(1.0, (2 * at_most + 64) / max(df.count(), 1))
    return df.where(place < F.lit(int(share * (1 << 40)))).orderBy(place, *by).limit(at_most)


#: Rows of a group from which on it counts as hot, and the parts that it is dealt to.
HOT, SALTS = 4_096, 64


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, salt: Column) -> DataFrame:
    """rows with the columns of their group (an inner join on keys; null keys are equal), but that a hot group's rows spread.

    groups has a row for each key and, as size, the number of rows that have it. Rows find hot groups by key and a salt of
    their own; the others then meet by key alone, with what was found already out of the way.
    """
    more = [c for c in groups.columns if c not in keys]
    same = lambda n: [F.col(k).eqNullSafe(F.col(f"_g{n}_{i}")) for i, k in enumerate(keys)]
    named = lambda n, df: df.select(*(F.col(k).alias(f"_g{n}_{i}") for i, k in enumerate(keys)), F.struct(*more).alias(f"_f{n}"))
    hot = named(0, groups.where(F.col(size) > HOT)).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cold = named(1, groups.where(F.col(size) <= HOT))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt, F.spark_partition_id()), F.lit(SALTS)).cast("int"))
    first = salted.join(hot, [*same(0), F.col("_salt") == F.col("_at")], "left")
    # a row that is done looks under a key of its own, so that it doesn't crowd the hot group's
    left = F.when(F.col("_f0").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(salt, F.spark_partition_id()).bitwiseOR(F.lit(1).cast("long")))
    both = first.withColumn("_left", left).join(cold.withColumn("_none", F.lit(0).cast("long")), [*same(1), F.col("_left") == F.col("_none")], "left")
    found = both.withColumn("_f", F.coalesce("_f0", "_f1")).where("_f is not null")
    return found.select(*rows.columns, *(F.col(f"_f.{c}").alias(c) for c in more))



def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same keys that come before, by bucket and then by order.

    bucket must not contradict the wanted order. A key may hold any share of all rows: only one row per key and bucket
    meets in one task, then each bucket is ranked on its own. Null keys form a group of their own.
    """
    by = [*keys, bucket]
    sums = df.groupBy(*by).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    joined = df.join(base, same, "inner")
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_base", *(f"_k{i}" for i in range(len(by))))
