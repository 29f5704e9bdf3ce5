"""Which codec packs a record best. Packing runs in Arrow batches; only sizes come back. A null payload is empty."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagfold.ship import ship

#: Codecs in the order in which they are tried; one that doesn't make a record smaller doesn't count.
CODECS = ("zlib", "zstd")
#: All that can be asked for.
KNOWN = (*CODECS, "snappy", "lz4", "brotli")
LEAST_BYTES = 256
#: Records that are packed before their sizes leave a task.
ROWS = 256


def codec_of(name: str) -> pa.Codec:
    return pa.Codec("lz4_raw" if name == "lz4" else name)


def packed(name: str, data: bytes) -> bytes:
    return zlib.compress(data) if name == "zlib" else codec_of(name).compress(data, asbytes=True)


def unpacked(name: str, data: bytes, usize: int) -> bytes:
    """What packed() was given; usize is its size, as records keep it."""
    return zlib.decompress(data) if name == "zlib" else codec_of(name).decompress(data, usize, asbytes=True)


def sizes(records: DataFrame, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """id, usize, codec, ord and size for each codec; records: (id, payload)."""
    ship(records.sparkSession)
    n = len(codecs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                data = [x or b"" for x in part.column(1).to_pylist()]
                rows = pa.array([i for i in range(len(data)) for _ in codecs])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([len(x) for x in data for _ in codecs], pa.int64()), pa.array(list(codecs) * len(data)), pa.array(list(range(n)) * len(data), pa.int32()), pa.array([len(packed(c, x)) for x in data for c in codecs], pa.int64())], names=["id", "usize", "codec", "ord", "size"])

    return records.select("id", F.col("payload").cast("binary")).mapInArrow(run, "id string, usize long, codec string, ord int, size long")


def recoded(records: DataFrame, codec: str, back: bool = False) -> DataFrame:
    """records (id, payload) packed by a codec: id, usize, payload; back: such rows unpacked again."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                data = [x or b"" for x in part.column(2).to_pylist()]
                out = [unpacked(codec, x, n) if back else packed(codec, x) for x, n in zip(data, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(out, pa.binary())], names=["id", "usize", "payload"])

    usize = F.col("usize") if back else F.coalesce(F.octet_length("payload"), F.lit(0))
    return records.select("id", usize.cast("long").alias("usize"), F.col("payload").cast("binary")).mapInArrow(run, "id string, usize long, payload binary")


def optimizable(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Records (id, usize, ...) that are worth packing anew."""
    return records.where(F.col("usize") >= least)


def best(records: DataFrame, current: str = "snappy", codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """id, usize, codec and size of the smallest packing other than the current codec; records of LEAST_BYTES or more only."""
    tried = sizes(records, codecs).where((F.col("usize") >= LEAST_BYTES) & (F.col("codec") != current) & (F.col("size") < F.col("usize")))
    return tried.groupBy("id", "usize").agg(F.min_by("codec", F.struct("size", "ord")).alias("codec"), F.min("size").alias("size"))


#: Fixed value: runs of the 5-bit code; letters and digits go in eights, capitals in sixteens, each with the signs beside them in ASCII.
RUNS = r"[\n`-~]{1,8}|[ -?]{1,8}|[@-_]{1,16}"


def hesper_size(text: Column) -> Column:
    """Bytes of a text in the 5-bit run code: five bits for each character and run; null if it isn't printable ASCII or doesn't get smaller."""
    n = F.octet_length(text)
    size = F.floor((5 * (n + F.regexp_count(text, F.lit(RUNS))) + 7) / 8)
    return F.when(text.rlike(r"^[\n -~]+\z") & (size < n), size)
