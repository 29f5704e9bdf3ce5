"""Cache state, command logs and URL sets derived from the star-schema tables, deterministically and in integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.functions import lifetimes
from tagfold.ship import ship

EPOCH, NOW = 1_704_067_200, 1_706_745_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fpc_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records (id, ua, tags, mtime, lifetime, expire, usize, lru_seq) made of documents; payloads are left out."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    lifetime = F.when(n % 5 == 0, 0).when(n % 5 == 1, -1).otherwise(n % 97 * 86_400 + 60)
    tags = F.when(n % 10 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array("lang", "source")))
    rows = d.select(
        F.concat(F.lit("doc-"), n.cast("string")).alias("id"), (n % 4).cast("int").alias("ua"), tags.alias("tags"), (n * 60 + EPOCH).alias("mtime"),
        lifetime.cast("long").alias("lifetime"), F.octet_length("text").cast("long").alias("usize"), (n * 7919 % 1_000_003).alias("lru_seq"),
    )
    return rows.withColumn("expire", lifetimes.fpc_expire(F.col("mtime"), F.col("lifetime"), F.col("ua")))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session commands (seq, ts, id, ua, op, lifetime, request_id) made of events."""
    return session_log_of(table(spark, sf_dir, "events"))


def session_log_of(e: DataFrame) -> DataFrame:
    """The same for any rows of events, a stream's too."""
    op = F.when(F.col("event_type") == "view", "READ").when(F.col("event_type") == "error", "DESTROY").otherwise("WRITE")
    lifetime = F.when(F.col("event_type") == "click", -1).when(F.col("event_type") == "purchase", F.floor("value") * 60 + 60).when(F.col("event_type") == "signup", 0)
    ts = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_id").alias("seq"), ts.cast("long").alias("ts"), F.concat(F.lit("sess-"), F.col("user_id").cast("string")).alias("id"),
        (F.col("user_id") % 4).cast("int").alias("ua"), op.alias("op"), lifetime.cast("long").alias("lifetime"), (F.col("event_id") + 1).alias("request_id"),
    )


def url_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("url", (F.col("page_id") % 11 * 100).alias("priority_milli"), (F.col("page_id") * 3600 + EPOCH).alias("lastmod"), F.col("page_id").alias("ord"))


def order_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tagged records, for queries at a larger scale."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))


def page_log_of(e: DataFrame, old: bool = False) -> DataFrame:
    """Page commands made of rows of events (a stream's too): signups and purchases save a page, clicks touch it, views load it
    or test for it, errors remove it, or clean by tags. old: some of them clean expired pages."""
    n, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    clean = (kind == "error") & (n % 20 == 0)
    op = F.when(kind.isin("signup", "purchase"), "SAVE").when(kind == "click", "TOUCH").when(kind == "view", F.when(n % 3 == 0, "TEST").otherwise("LOAD")).when(clean, "CLEAN").otherwise("REMOVE")
    mode = F.element_at(F.array(*map(F.lit, ("matchall", "matchall", "matchany", "matchall", "matchall", "matchnot", "matchall", "old" if old else "matchany"))), (F.floor(n / 20) % 8 + 1).cast("int"))
    tags = F.array(F.concat(F.lit("t"), (n % 7).cast("string")), F.concat(F.lit("u"), (u % 5).cast("string")))
    lifetime = F.when(kind == "signup", F.when(n % 4 == 0, 0).otherwise(-1)).when(kind == "purchase", F.floor("value") * 600 + 60).when(kind == "click", n % 50 * 1000)
    ts = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(
        n.alias("seq"), ts.cast("long").alias("ts"), F.concat(F.lit("page-"), (u * 3 + n % 3).cast("string")).alias("id"), (n % 4).cast("int").alias("ua"), op.alias("op"), lifetime.cast("long").alias("lifetime"),
        F.when((op == "SAVE") & (n % 11 != 0) | clean, tags).alias("tags"), F.when(op == "SAVE", F.floor("value") + 1).cast("long").alias("usize"), F.when(clean, mode).alias("mode"),
    )


def page_log(spark: SparkSession, sf_dir: str, old: bool = False) -> DataFrame:
    return page_log_of(table(spark, sf_dir, "events"), old)
