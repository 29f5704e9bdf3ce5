"""Console scripts as command rows: one command a line, words in quotes kept whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.functions.scalars import unescaped

#: A quoted string or a run without white space.
TOKEN = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`|[^\s'"`]+"""
#: Scripts within scripts, at most.
DEPTH = 8


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (the line's number), op (upper case) and args of each command; blank lines and comments (#) are skipped."""
    text = F.split("value", r"\r?\n")
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(text).alias("n", "value"))
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    found = F.regexp_extract_all(line, F.lit(TOKEN), 0)
    bare = F.transform(found, lambda t: F.when(t.rlike(r"""(?s)^(['"`]).*\1$"""), unescaped(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t))
    return rows.where((line != "") & ~line.startswith("#")).select("file", "n", F.upper(F.get(bare, F.lit(0))).alias("op"), F.slice(bare, 2, 1 << 20).alias("args"))


def commands(spark: SparkSession, path: str, payloads: DataFrame | None = None) -> DataFrame:
    """op and args of script files in the order of at (line numbers, those of an executed script below its own).

    EXECUTE runs the script that it names, with a path as this one's files have it, DEPTH deep at most; an argument @file
    is the text of that file where payloads (file, text) has it.
    """
    found = lines(spark, path).select(F.array("n").alias("at"), "op", "args")
    for depth in range(DEPTH + 1):
        run = found.where("op = 'EXECUTE'").select("at", F.get("args", F.lit(0)).alias("script")).collect()  # a script's few EXECUTEs
        if not run:
            break
        if depth == DEPTH:
            raise ValueError(f"scripts execute scripts more than {DEPTH} deep")
        found = found.where("op != 'EXECUTE'")
        for r in run:
            inner = lines(spark, r["script"]).select(F.concat(F.array(*map(F.lit, r["at"])), F.array("n")).alias("at"), "op", "args")
            found = found.unionByName(inner)
    if payloads is not None:
        named = F.transform("args", lambda x: F.struct(F.when(x.startswith("@"), F.substring(x, 2, 1 << 20)).alias("file"), x.alias("arg")))
        one = found.select("at", "op", F.posexplode_outer(named).alias("i", "a")).select("at", "op", "i", F.col("a.file").alias("file"), F.col("a.arg").alias("arg"))
        texts = one.join(payloads.select("file", "text"), "file", "left").withColumn("arg", F.coalesce("text", "arg"))
        parts = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "arg"))))
        found = texts.groupBy("at", "op").agg(parts.alias("p")).select("at", "op", F.col("p.arg").alias("args"))
    return found
