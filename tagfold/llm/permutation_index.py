"""Approximate nearest neighbours by a permutation index.

PIVOTS distinct vectors, a bounded sample of the table, stand for the space. Each vector is represented by its PREFIX
nearest pivots in order, and posted in the inverted file of each of these, by blocks of vectors. A query walks the files of
its own nearest pivots only, about PREFIX in PIVOTS of all postings: what each shared pivot takes off the footrule distance
adds up for the vectors that are posted there. Those within the query's cutoff are reranked by Euclidean distance in double
precision, and the best of all blocks are kept. The cutoff is the distance within which a share of the pivots themselves
lies, so it is the same in every block and nothing has to be ranked to know it; ties at the cutoff are all reranked.

The index is fitted on the pivots alone; every row is posted. Blocks are dealt by a hash of vec_id, so copies of one vector
spread; queries go to every block in chunks, and no task holds more than a block and a chunk. (Posting rows that queries
find by a join on the pivot give the same candidates, but then each pair of a query and a candidate is a row between joins.)

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than most have (of equally frequent lengths the shorter one); of rows that repeat a vec_id one counts, the one with
the smallest vector; ties go to the smaller vec_id; fewer candidates than k are all returned; an empty table gives no rows;
vectors of any length are used whole; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tagfold.llm.common import sampled, saved

PIVOTS, PREFIX = 2_048, 32
#: Share of the pivots that a query's cutoff takes in.
SHARE = 0.25
#: Vectors of a block and queries of a chunk, about; vectors whose pivots are ordered at a time.
BLOCK, CHUNK, ORDERED = 1 << 14, 1 << 16, 1_024
FOUND = "query_id long, vec_id long, score double"


def valid(table: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null").where(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def chosen(rows: DataFrame, pivots: int, seed: int) -> np.ndarray:
    """Up to pivots distinct vectors, of the 2 * pivots rows with the smallest hashes."""
    few = [r["v"] for r in sampled(rows, 2 * pivots, "vec_id", seed=seed).collect()]
    return np.array(list(dict.fromkeys(map(tuple, few)))[:pivots], float)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each row of x, nearest first; ties to the earlier pivot."""
    far = (pivots * pivots).sum(1) - 2 * x @ pivots.T
    if prefix < len(pivots):
        # all that are as near as the last one of the prefix, and of these the first in order
        limit = np.partition(far, prefix - 1, axis=1)[:, prefix - 1 : prefix]
        far = np.where(far <= limit, far, np.inf)
    return np.argsort(far, axis=1, kind="stable")[:, :prefix]


def gain(i: int, j: np.ndarray, n: int) -> np.ndarray:
    """What a pivot at places i and j of two prefixes of n takes off their footrule distance, n * (n + 1) if they share none.

    A pivot that a prefix lacks stands right behind its last one.
    """
    return 2 * n - i - j - abs(i - j)


def footrules(order: np.ndarray, others: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distances of each row of order to each of others, both of the same length."""
    n = order.shape[1]
    place = np.full((len(others), pivots), n)
    np.put_along_axis(place, others, np.arange(n)[None].repeat(len(others), 0), 1)
    out = np.full((len(order), len(others)), n * (n + 1))
    for i in range(n):
        at = place[:, order[:, i]].T
        out -= np.where(at < n, gain(i, at, n), 0)
    return out


class Postings:
    """The inverted files of a block: for each pivot the rows that have it in their prefix, and at which place."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.rows, self.n = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.row, self.place = np.divmod(by_pivot, self.n)

    def within(self, order: np.ndarray, cutoff: int) -> np.ndarray:
        """The posted rows whose footrule distance to a query's order is at most cutoff."""
        total = np.zeros(self.rows, np.int64)
        for i, p in enumerate(order):
            at = slice(self.starts[p], self.starts[p + 1])
            total[self.row[at]] += gain(i, self.place[at], self.n)
        return np.flatnonzero((total > 0) & (self.n * (self.n + 1) - total <= cutoff))


def search(table: DataFrame, is_query: Column, k: int = 10, share: float = SHARE, pivots: int = PIVOTS, prefix: int = PREFIX, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest of each query among all other rows of table (vec_id, embedding)."""
    rows = saved(valid(table).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    some = chosen(rows, pivots, seed)
    if not len(some):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = min(prefix, len(some))
    of_pivots = orders(some, some, n)
    # the query itself and k others at least are within the cutoff, as far as pivots tell
    within = min(len(some), max(k + 1, int(np.ceil(share * len(some)))))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ORDERED):
                part = b.slice(at, ORDERED)
                order = orders(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1), some, n)
                asks = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                cut = np.zeros(len(order), np.int64)
                if asks.any():
                    cut[asks] = np.partition(footrules(order[asks], of_pivots, len(some)), within - 1, axis=1)[:, within - 1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())), pa.array(cut)], names=["vec_id", "v", "asks", "pivots", "cutoff"])

    index = saved(rows.withColumn("asks", F.coalesce(is_query, F.lit(False))).mapInArrow(ordered, "vec_id long, v array<double>, asks boolean, pivots array<int>, cutoff long"), "permutations")
    sizes = index.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, chunks = max(1, -(-sizes["n"] // BLOCK)), max(1, -(-sizes["q"] // CHUNK))
    every = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    dealt = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every(chunks).alias("chunk"), "vec_id", "v", "pivots")
    asked = index.where("asks").select(every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(chunks)).cast("int").alias("chunk"), "vec_id", "v", "pivots", "cutoff")

    def best(block: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(query):
            return pd.DataFrame({"query_id": pd.Series([], "int64"), "vec_id": pd.Series([], "int64"), "score": pd.Series([], "float64")})
        block = block.sort_values("vec_id")
        ids, x, files = block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy()), Postings(np.stack(block["pivots"].to_numpy()), len(some))
        out = []
        for q, v, order, cutoff in zip(query["vec_id"], query["v"], query["pivots"], query["cutoff"]):
            near = files.within(order, cutoff)
            near = near[ids[near] != q]
            score = np.sqrt(((x[near] - v) ** 2).sum(1))
            top = np.argsort(score, kind="stable")[:k]  # rows are in the order of ids
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near][top], "score": score[top]}))
        return pd.concat(out)

    found = dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(best, FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Brute force in DuckDB's SQL, for the recall of search(): every query against every row.
BRUTE_FORCE_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) ** 2))) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM d
QUALIFY rank <= 10
"""
