"""Snapshots, replay and replication of stores as Parquet folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.functions import lifetimes as L
from tagfold.operators.commands import REPLICATED, status
from tagfold.operators.tags import linked


#: Temporary folders of sessions without a shared one.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all of a cluster sees; a temporary one only on a single machine where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        name = spark.sparkContext.applicationId
        found = _own.get(name) or _own.setdefault(name, tempfile.mkdtemp(prefix="tagfold-"))
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def fpc_rows(fpc: DataFrame, now: int, min_ua: int = 0) -> DataFrame:
    """SAVE commands that bring a page store back: what is left of each lifetime, one second for expired records."""
    left = F.when(F.col("expire") > now, F.col("expire") - now).otherwise(1).cast("long")
    return fpc.where(F.col("ua") >= min_ua).select("id", "ua", linked(F.col("tags")).alias("tags"), left.alias("lifetime"), "usize", "lru_seq")


def session_rows(sessions: DataFrame, now: int, min_ua: int = 0) -> DataFrame:
    """WRITE commands that bring a session store back; expired sessions are left out."""
    return sessions.where((F.col("ua") >= min_ua) & (F.col("expire") > now)).select("id", "ua", (F.col("expire") - now).alias("lifetime"), "lru_seq")


def store(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").parquet(path)
    return path


def store_all(sessions: DataFrame, fpc: DataFrame, path: str, now: int, min_ua: int = 0) -> str:
    """A snapshot of both domains in one folder: sessions, then pages, each in its part."""
    store(session_rows(sessions, now, min_ua), f"{path}/domain=session")
    return store(fpc_rows(fpc, now, min_ua), f"{path}/domain=fpc").removesuffix("/domain=fpc")


def config_lines(spark: SparkSession, path: str) -> DataFrame:
    """name and value of each "name value" line of configuration files; blank lines and comments (#) are skipped."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return rows.select(F.regexp_extract(line, r"^(\S+)\s+(.*)$", 1).alias("name"), F.trim(F.regexp_replace(F.regexp_extract(line, r"^(\S+)\s+(.*)$", 2), r"\s#.*$", "")).alias("value")).where("name != ''")


def restore_fpc(spark: SparkSession, path: str, now: int) -> DataFrame:
    """A page store from a snapshot: lifetimes count from now and are clipped; the reserved tag means none."""
    r = spark.read.parquet(path)
    tags = F.filter("tags", lambda t: t != F.lit("<<< UNTAGGED >>>"))
    return r.select("id", "ua", tags.alias("tags"), F.lit(now).cast("long").alias("mtime"), L.fpc_expire(F.lit(now).cast("long"), F.col("lifetime"), F.col("ua")).alias("expire"), "usize", "lru_seq")


def replicated(log: DataFrame, from_network: str | None = None) -> DataFrame:
    """The commands that go to replicas and binlogs: mutating ones, and of these only what didn't come from a file itself."""
    out = log.where(F.col("op").isin(*REPLICATED.split()))
    return out.where(F.col(from_network)) if from_network else out


#: What a binlog's header says; another version is another format of commands.
SIGNATURE, VERSION = "tagfold binlog", 1


def binlog(log: DataFrame, path: str, from_network: str | None = None) -> str:
    """Appends mutating commands to a binlog: a folder with a header and commands. from_network: as in replicated(), so that
    what was replayed from a binlog isn't written to one again."""
    spark = log.sparkSession
    header = spark.createDataFrame([(SIGNATURE, VERSION)], "signature string, version int").coalesce(1)
    header.write.mode("overwrite").json(f"{path}/header")
    replicated(log, from_network).write.mode("append").parquet(f"{path}/commands")
    return path


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """The commands of a binlog up to its first bad one, with from_network false; raises ValueError for another kind of folder."""
    header = spark.read.schema("signature string, version int").json(f"{path}/header").first()
    if header is None or header["signature"] != SIGNATURE:
        raise ValueError(f"{path} is no binlog")
    if header["version"] != VERSION:
        raise ValueError(f"{path} has version {header['version']}, not {VERSION}")
    log = spark.read.parquet(f"{path}/commands")
    known = F.col("op").isin(*REPLICATED.split())
    named = F.col("op").isin("CLEAN", "GC") | (status(F.col("id"), F.col("ua"), F.col("lifetime")) == "ok")
    bad = log.where(~F.coalesce(known & named, F.lit(False))).agg(F.min("seq")).first()[0]
    return (log if bad is None else log.where(F.col("seq") < bad)).withColumn("from_network", F.lit(False))


def saved(spark: SparkSession, what: str):
    """Writes a DataFrame below the shared folder and reads it back."""

    def save(df: DataFrame) -> DataFrame:
        path = new_folder(spark, what)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs from text lines "0.75 http://..."; blank lines and those from # on are skipped."""
    line = F.trim("value")
    pattern = r"^([\d.]+)\s+(https?://.+)$"
    rows = spark.read.text(path).where(line.rlike(pattern)).select(F.regexp_extract(line, pattern, 2).alias("url"), F.round(F.regexp_extract(line, pattern, 1).cast("double") * 1000).cast("long").alias("priority_milli"))
    return rows


def site_map(spark: SparkSession, path: str) -> DataFrame:
    """URLs of site-map files that have loc, lastmod and a priority from 0 to 1."""
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<url>(.*?)</url>"), 1)).alias("entry")
    get = lambda name: F.regexp_extract("entry", rf"<{name}>\s*(.*?)\s*</{name}>", 1)
    rows = spark.read.text(path, wholetext=True).select(entry).select(get("loc").alias("url"), get("priority").alias("_p"), get("lastmod").alias("_m"))
    fine = rows.where((F.col("url") != "") & F.col("_p").rlike(r"^(0(\.\d+)?|1(\.0+)?)$"))
    return fine.select("url", F.round(F.col("_p").cast("double") * 1000).cast("long").alias("priority_milli"), F.unix_timestamp(F.try_to_timestamp("_m")).alias("lastmod")).where("lastmod is not null")


