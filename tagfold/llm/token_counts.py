"""Token counts with a digest cache.

A document's content (null: empty) is named by its SHA-256, a tokenizer by that of its file and the library's version.
Counts are joined from the cache, a Parquet folder; of the digests that it lacks, one document each is encoded and the
counts are appended. Normalising means no more than null to empty: anything else could change a count.

Defined cases: a null text counts as empty: no bytes, no tokens; repeated rows each get their count; two writers may
append the same digest, which is read once; texts of any length are encoded whole; an empty table gives no rows and appends
none; other columns, whatever they are called, play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagfold.llm import tokens
from tagfold.llm.common import joined_to_groups, saved, scratch

CACHE = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
LIMIT = 1_024
#: Texts that are encoded at a time.
CHUNK = 256


def version_of(path: str) -> str:
    """Digest of a tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def cached(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """digest, n_tokens of a version, each digest once; none if the cache doesn't exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    return spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encoded(rows: DataFrame, path: str, version: str) -> DataFrame:
    """rows: (digest, content); a CACHE row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = tokens.encoder(path), set()
        for b in batches:
            # rows that repeat a document meet in one task
            first = [not (x in seen or seen.add(x)) for x in b.column(0).to_pylist()]
            if not all(first):
                b = b.filter(pa.array(first, pa.bool_()))
            counts = [len(x) // 4 for i in range(0, b.num_rows, CHUNK) for x in enc.encode(b.column(1).slice(i, CHUNK).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([version] * b.num_rows, pa.string()), b.column(0), pa.array(counts, pa.int64())], names=CACHE.names)

    return rows.mapInArrow(run, CACHE)


def count(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, one row per row of docs; cache_path keeps counts from call to call."""
    spark, version = docs.sparkSession, version_of(tokenizer_path)
    cache_path = cache_path or scratch(spark, "token-counts")
    content = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")).withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    light = saved(content.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes")), "token-digests")
    known = cached(spark, cache_path, version)
    # one document names each missing digest, so that no group of copies meets in one task with its texts
    misses = light.groupBy("digest").agg(F.min(F.struct(F.col("doc_id"))).alias("_of")).join(known, "digest", "left_anti").select(F.col("digest").alias("_digest"), F.col("_of.doc_id").alias("_doc"))
    named = content.join(misses.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left_semi")
    encoded(named.select("digest", "content"), tokenizer_path, version).write.mode("append").parquet(cache_path)
    # copies of a text may be any share of all rows
    counts = light.groupBy("digest").agg(F.count("*").alias("_n")).join(cached(spark, cache_path, version), "digest")
    return joined_to_groups(light, counts, ["digest"], "_n", F.col("doc_id")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
