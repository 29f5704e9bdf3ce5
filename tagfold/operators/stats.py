"""Counters over records: numbers, ranges, fixed-bucket histograms, filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagfold.functions.scalars import plural


def histogram(df: DataFrame, value: Column, buckets: int) -> DataFrame:
    """bucket, num: how often each value below buckets - 1 occurs; the last bucket has the rest, and empty ones are there too."""
    spine = df.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    found = df.select(F.least(value.cast("long"), F.lit(buckets - 1)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("_n"))
    return spine.join(found, "bucket", "left").select("bucket", F.coalesce("_n", F.lit(0)).alias("num"))


def value_range(df: DataFrame, value: Column) -> DataFrame:
    """One row: the smallest and greatest value and both as min..max, or (none)."""
    r = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return r.select("low", "high", F.coalesce(F.concat(F.col("low").cast("string"), F.lit(".."), F.col("high").cast("string")), F.lit("(none)")).alias("shown"))


def filling(state: DataFrame, quota: int) -> DataFrame:
    return state.agg((F.least(F.lit(100), F.expr(f"coalesce(sum(usize), 0) * 100 div {quota}")) if quota else F.lit(0)).cast("long").alias("percentage"))


def info(domains: dict[str, DataFrame]) -> DataFrame:
    """domain, ua, num and bytes of records, with totals over classes (ua null) by rollup."""
    parts = [df.select(F.lit(name).alias("domain"), "ua", "usize") for name, df in domains.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.rollup("domain", "ua").agg(F.count("*").alias("num"), F.coalesce(F.sum("usize"), F.lit(0)).alias("bytes"))


def info_lines(domains: dict[str, DataFrame], quotas: dict[str, int | None]) -> DataFrame:
    """name and line, as INFO shows them: memory and records of each domain (rows with usize), memory of all, and the quota of all (key "")."""
    used = [df.agg(F.lit(name).alias("name"), F.coalesce(F.sum("usize"), F.lit(0)).alias("used"), F.count("*").alias("n")) for name, df in domains.items()]
    every = used[0]
    for p in used[1:]:
        every = every.unionByName(p)
    quota = F.lit("not set")
    for name, value in quotas.items():
        quota = F.when(F.col("name") == name, F.lit("not set" if value is None else str(value))).otherwise(quota)
    memory = F.concat("name", F.lit(" memory: "), F.col("used").cast("string"), F.lit(" / "), quota, F.lit(" bytes (used / quota)"))
    store = F.concat("name", F.lit(" store: "), plural(F.col("n"), "record"))
    total = every.agg(F.sum("used").alias("used"))
    whole = quotas.get("")
    combined = F.lit("Combined memory quota: " + ("not set" if whole is None else f"{whole} bytes"))
    lines = every.select("name", F.explode(F.array(memory, store)).alias("line"))
    return lines.unionByName(total.select(F.lit("Global").alias("name"), F.explode(F.array(F.concat(F.lit("Global memory: "), F.col("used").cast("string"), F.lit(" bytes used")), combined)).alias("line")))


def sliced(rows: DataFrame, order: list[Column], first: int, number: int) -> DataFrame:
    """A page of a result: number rows (0: all) from first on, in an order."""
    page = rows.orderBy(*order).offset(first)
    return page.limit(number) if number else page


def sliced_text(text: Column, first: int, number: int) -> Column:
    """A page of a payload: number characters (0: all) from first on."""
    return F.substring(text, first + 1, number or 1 << 30)


#: Most records checked and recompressed in a run by the server's load (0, up to 33, 66, below 100, 100 percent).
CHECKS, RECOMPRESSIONS = (1_000_000_000, 1_000, 500, 200, 100), (1_000_000_000, 100, 25, 10, 0)


def work_cap(load: int, caps: tuple[int, ...] = CHECKS) -> int:
    """How many records a maintenance run may look at under a load in percent."""
    return caps[0 if load <= 0 else 1 if load <= 33 else 2 if load <= 66 else 3 if load < 100 else 4]


def wildcard(named: DataFrame, masks: DataFrame, column: str = "name") -> DataFrame:
    """A row of named for each mask of masks (mask, pattern) that it matches; bag semantics: two masks give two rows.

    masks holds a request's few masks; those of 128 characters and more are ignored.
    """
    return named.join(masks.where(F.length("mask") < 128), F.expr(f"{column} ilike pattern"))


def check(answers: DataFrame, metrics: DataFrame, limits: dict[str, tuple[str, int]], load: int) -> DataFrame:
    """One row: load (percent, given), warnings (of health()) and errors (answers whose status isn't ok)."""
    errors = answers.agg(F.count_if(F.col("status") != "ok").alias("errors"))
    warnings = health(metrics, limits).agg(F.count_if(F.col("status") == "warning").alias("warnings"))
    # one row each
    return errors.crossJoin(warnings).select(F.lit(load).cast("long").alias("load"), "warnings", "errors")


def health(metrics: DataFrame, limits: dict[str, tuple[str, int]]) -> DataFrame:
    """metrics (name, value) with status: warning where a value is below ("min") or above ("max") its limit."""
    status = F.lit("ok")
    for name, (kind, limit) in limits.items():
        beyond = F.col("value") < limit if kind == "min" else F.col("value") > limit
        status = F.when((F.col("name") == name) & beyond, "warning").otherwise(status)
    return metrics.withColumn("status", status)
