"""Near-duplicate documents by one-permutation MinHash, exactly confirmed.

A document's 5-word shingles are hashed once; each of BINS ranges of the hash keeps its smallest value, and ranges without
any borrow one by optimal densification. Documents with the same set are one node. Bands of the signature deal the nodes
to buckets, and each bucket gives star-shaped candidate edges only: from its most popular node (the one that shares most
buckets with others, as the original among its copies does) to every other. Edges are confirmed on the full sets.

What a star leaves out is made up for: two linked nodes of a bucket that are not both linked with its centre. For each
centre, members in another component are compared with the centre's other members in blocks, by signature; a few of the
closest in each component are confirmed, and only if none of these holds the full sets of the others.

Links have a Jaccard similarity of at least 75 %. A pair at 75 % shares none of the BANDS buckets with a chance below 1 in
100,000; other losses have a chance of that order: a signature estimate more than 5 standard deviations off.

Defined cases: a text without words (null, empty) has 0 shingles and links with nothing; with fewer than five words the
whole sequence is the one shingle; equal texts are one group; a row that repeats a doc_id is judged by its own text; a row
without a doc_id stands for a group only if none of its rows has one (component_id is null then), and is kept where unnamed
rows are asked for; ties go to the smaller key; texts of any length are taken whole; an empty table gives no rows; other
columns, whatever they are called, play no part. Rows and sets go by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagfold.llm.common import joined_to_groups, saved

SHINGLE, PERCENT = 5, 75
BITS = 7
BINS, ROWS = 1 << BITS, 4
BANDS = BINS // ROWS
#: A pair whose signatures agree less isn't confirmed: by the size of the smaller set, whose estimates vary the more the
#: fewer bins it fills. Sets below the least size are confirmed at any estimate.
LEAST_ESTIMATES = {BINS: 0.55, 40: 0.4}
#: Nodes of a centre that are compared with as many others at a time.
BLOCK = 256
#: Candidates of a node in one component and block that are confirmed first.
BEST = 4
#: Attempts of densification before an empty bin takes the next full one.
ATTEMPTS = 64

_ODD = np.random.default_rng(20_240_101).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PROBE = np.random.default_rng(20_240_102).integers(0, BINS, (ATTEMPTS, BINS))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    h = np.full(len(words) - n + 1, _ODD[n + 8], np.uint64)
    for i in range(n):
        h += ids[i : len(words) - n + 1 + i] * _ODD[i]
    return np.unique(mixed(h))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest 32 bits after the bin's own of each bin, empty bins densified; hashes is sorted and not empty."""
    starts = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BITS))
    bins = np.full(BINS, -1, np.int64)
    at = np.minimum(starts, len(hashes) - 1)
    own = (hashes[at] >> np.uint64(64 - BITS)) == np.arange(BINS, dtype=np.uint64)
    own &= starts < len(hashes)
    value = (hashes[at] >> np.uint64(32 - BITS)) & np.uint64(0xFFFFFFFF)
    bins[own] = value[own].astype(np.int64)
    if not own.all():
        source = np.where(own, np.arange(BINS), -1)
        for probe in _PROBE:
            empty = source < 0
            if not empty.any():
                break
            source[empty & own[probe]] = probe[empty & own[probe]]
        if (source < 0).any():
            full = np.flatnonzero(own)
            source[source < 0] = full[np.searchsorted(full, np.flatnonzero(source < 0)) % len(full)]
        bins = bins[source]
    return bins.astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((rows * _ODD[20 : 20 + ROWS]).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[30])


def may_link(agree: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Whether pairs are to be confirmed, by the share of agreeing bins and the size of the smaller set."""
    least = np.zeros(len(agree))
    for size, estimate in LEAST_ESTIMATES.items():
        least = np.maximum(least, np.where(smaller >= size, estimate, 0))
    return agree >= least


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = int((a[at] == b).sum())
    return 100 * same >= PERCENT * (len(a) + len(b) - same)


def row_key() -> Column:
    """The internal key of a row: rows with the same doc_id and text are one, whether doc_id is null or not."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


SKETCH = [T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (its key), n_shingles, set_id (names the set), signature and bands of each row; the last three null without words."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("row", T.LongType()), *SKETCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, sigs, keys = [], [], [], []
            for text in b.column(2):
                h = shingles(text.as_py())
                sizes.append(len(h))
                names.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig = signature(h) if len(h) else None
                sigs.append(None if sig is None else sig.tobytes())
                keys.append(None if sig is None else bands(sig).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(run, schema)


def stars(keyed: DataFrame) -> DataFrame:
    """keyed: (key, node). Candidate edges (center, node): for each key from its most popular node to its others."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = saved(keyed.join(sizes, "key"), "near-buckets")
    popular = shared.groupBy("node").agg(F.sum("_n").alias("_popular"))
    shared = saved(shared.join(popular, "node").select("key", "node", "_popular"), "near-members")
    centers = shared.groupBy("key").agg(F.max(F.struct("_popular", (-F.col("node")).alias("_less"))).alias("_best")).select("key", (-F.col("_best._less")).alias("center"))
    return shared.join(centers, "key").where("center != node").select("center", "node").distinct()


def estimated(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """pairs (a, b) with close: whether their signatures (node, signature, n_shingles) agree enough to be confirmed."""
    of = lambda x: sigs.select(F.col("node").alias(x), F.col("signature").alias(f"_s{x}"), F.col("n_shingles").alias(f"_n{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            a, b = (np.frombuffer(b"".join(r.column(i).to_pylist()), np.uint32).reshape(-1, BINS) for i in (2, 3))
            close = may_link((a == b).mean(1), np.minimum(r.column(4).to_numpy(), r.column(5).to_numpy()))
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(close)], names=["a", "b", "close"])

    return both.select("a", "b", "_sa", "_sb", "_na", "_nb").mapInArrow(run, "a long, b long, close boolean")


def full_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """node and set (sorted 64-bit hashes) of the rows named by ids (node), each once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            yield pa.RecordBatch.from_arrays([r.column(0), pa.array([shingles(x.as_py()).tobytes() for x in r.column(1)], pa.binary())], names=["node", "set"])

    named = ids.select(F.col("node").alias("_node")).distinct()
    texts = docs.select(row_key().alias("_row"), "text").join(named.hint("shuffle_hash"), F.col("_row") == F.col("_node"), "left_semi").dropDuplicates(["_row"])
    return saved(texts.mapInArrow(sets, "node long, set binary"), "near-sets")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are linked, by the full sets of both."""
    pairs = saved(pairs, "near-pairs")
    full = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), docs)
    both = pairs.join(full.select(F.col("node").alias("b"), F.col("set").alias("_sb")), "b").join(full.select(F.col("node").alias("a"), F.col("set").alias("_sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            keep = pa.array([linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(r.column(2), r.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([r.column(0).filter(keep), r.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "_sa", "_sb").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes of edges (a, b).

    Each round every root hooks to its smallest neighbouring root, the trees that result are flattened, and edges are
    contracted to the roots. A root that none hooks to has a smaller neighbour one round later, so two rounds halve the
    roots of a component at least: rounds grow with the logarithm of its size, whatever its shape and the order of its ids.
    """
    links = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "near-edges")
    labels = None
    while links.limit(1).count():
        roots = saved(flattened(saved(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "near-hooks")), "near-roots")
        at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}"))
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            labels = saved(labels.join(at("component"), "component", "left").select("node", F.coalesce("_component", "component").alias("component")), "near-labels")
        links = saved(links.join(at("a"), "a").join(at("b"), "b").where("_a != _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "near-edges")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def flattened(trees: DataFrame) -> DataFrame:
    """trees (node, root), each root a node or a smaller one's child, with the tree's root in place of the parent: paths halve until none is left."""
    while True:
        # only inner nodes lead further
        up = trees.where("node != root").select(F.col("node").alias("root"), F.col("root").alias("_up"))
        if not trees.join(up, "root", "left_semi").limit(1).count():
            return trees
        trees = saved(trees.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "near-hooks")


def left_out(edges: DataFrame, links: DataFrame, labels: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """Linked pairs (a, b) of members of one centre in different components.

    edges: (center, node), links: those that are confirmed. Members that aren't in their centre's component ask all others,
    BLOCK of either at a time; of a member's links into one component one is enough. Blocks compare signatures and name the
    BEST candidates of a member in a component, which are confirmed outside. Where none of these is linked but there are
    more, blocks with the full sets of just these members and what they ask decide.
    """
    mark = links.select("center", "node", F.lit(True).alias("_linked"))
    of = labels.withColumnRenamed("component", "_c")
    member = edges.join(mark, ["center", "node"], "left").join(of, "node", "left").withColumn("_c", F.coalesce("_c", "node"))
    # a centre may have any share of all nodes
    centers = edges.groupBy("center").agg(F.count("*").alias("_n")).join(of.withColumnRenamed("node", "center"), "center", "left").select("center", "_n", F.coalesce("_c", "center").alias("_cc"))
    member = joined_to_groups(member, centers, ["center"], "_n", F.col("node"))
    member = saved(member.select("center", "node", F.col("_c").alias("component"), (F.col("_linked").isNull() & (F.col("_c") != F.col("_cc"))).alias("asks")), "near-members")
    light = sigs.select("node", "signature", "n_shingles")
    near = saved(compared(asked(member).join(light, "node"), with_sets=False), "near-candidates")
    found = saved(confirmed(near.where("b is not null").select("a", "b").distinct(), docs), "near-found")
    settled = found.join(near.select("a", "b", "component"), ["a", "b"]).select("a", "component").distinct()
    open_ = saved(near.where("b is null").select("a", "component").distinct().join(settled, ["a", "component"], "left_anti"), "near-open")
    if not open_.limit(1).count():
        return found
    again = member.join(open_.select(F.col("a").alias("node"), F.lit(True).alias("_open")).distinct(), "node", "left").select("center", "node", "component", (F.col("asks") & F.col("_open").isNotNull()).alias("asks"))
    rows = saved(asked(again), "near-asked")
    rest = compared(rows.join(light, "node").join(full_sets(rows.select("node"), docs), "node"), with_sets=True)
    return found.union(rest.select("a", "b")).distinct()


def asked(member: DataFrame) -> DataFrame:
    """member with _blocks and _ask_blocks (of BLOCK rows each) for the centres where any row asks."""
    sizes = member.groupBy("center").agg(F.count("*").alias("_n"), F.sum(F.col("asks").cast("long")).alias("_asks")).where("_asks > 0 and _n > 1")
    sizes = sizes.select("center", "_n", F.ceil(F.col("_n") / BLOCK).alias("_blocks"), F.ceil(F.col("_asks") / BLOCK).alias("_ask_blocks"))
    return joined_to_groups(member, sizes, ["center"], "_n", F.col("node")).drop("_n")


def compared(rows: DataFrame, with_sets: bool) -> DataFrame:
    """a (an asking node), b and component (b's): candidates, and a row with null b where there are more; with_sets: links only."""
    own = ["node", "component", "signature", "n_shingles", *["set"] * with_sets]
    part = F.xxhash64("node")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    others = rows.select("center", F.pmod(part, F.col("_blocks")).alias("x"), F.explode(every("_ask_blocks")).alias("y"), *own, "asks")
    asking = rows.where("asks").select("center", F.explode(every("_blocks")).alias("x"), F.pmod(part, F.col("_ask_blocks")).alias("y"), *own)
    asking = asking.select(*(F.col(c).alias(f"q_{c}") for c in asking.columns))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = (np.frombuffer(b"".join(x), np.uint32).reshape(-1, BINS) for x in (left["q_signature"], right["signature"]))
            node, comp, size, asks = right["node"].to_numpy(), right["component"].to_numpy(), right["n_shingles"].to_numpy(), right["asks"].to_numpy(bool)
            for i, (sig, n, c, few) in enumerate(zip(a, left["q_node"], left["q_component"], left["q_n_shingles"])):
                agree = (b == sig).mean(1)
                near = np.flatnonzero((comp != c) & ~(asks & (node < n)) & may_link(agree, np.minimum(size, few)) & (100 * np.minimum(size, few) >= PERCENT * np.maximum(size, few)))
                near = near[np.argsort(-agree[near], kind="stable")]
                seen: dict[int, int] = {}
                for j in near:
                    k = seen.get(comp[j], 0)
                    if with_sets:
                        if not k and linked(np.frombuffer(left["q_set"].iat[i], np.uint64), np.frombuffer(right["set"].iat[j], np.uint64)):
                            seen[comp[j]] = 1
                            out.append((n, node[j], comp[j]))
                    elif k <= BEST:
                        seen[comp[j]] = k + 1
                        out.append((n, node[j] if k < BEST else None, comp[j]))
        found = pd.DataFrame(out, columns=["a", "b", "component"])
        return found.astype({"a": "int64", "b": "Int64", "component": "int64"})

    keys = ["center", "x", "y"]
    return asking.groupBy(*(f"q_{k}" for k in keys)).cogroup(others.groupBy(*keys)).applyInPandas(compare, "a long, b long, component long")


def judged(docs: DataFrame, unnamed: bool) -> DataFrame:
    """The columns of grouped() after row, each row's key."""
    sketch = saved(sketches(docs), "near-sketches")
    # of rows the one with the smallest doc_id stands for all, one without only for others without
    first = lambda doc, row: F.min(F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("doc"), F.col(row).alias("row")))
    groups = sketch.where("set_id is not null").groupBy("set_id").agg(first("doc_id", "row").alias("_first"))
    groups = saved(groups.select("set_id", F.col("_first.doc").alias("doc"), F.col("_first.row").alias("node")), "near-groups")
    # one node for each set: the key of the row that stands for it
    nodes = sketch.join(groups.select("node"), F.col("row") == F.col("node")).dropDuplicates(["node"])
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    edges = saved(stars(keyed), "near-stars")
    member = edges.select("node").union(edges.select(F.col("center").alias("node"))).distinct()
    sigs = saved(sketch.select(F.col("row").alias("node"), "signature", "n_shingles").where("signature is not null").join(member, "node", "left_semi").dropDuplicates(["node"]), "near-signatures")
    pairs = edges.select(F.col("center").alias("a"), F.col("node").alias("b"))
    links = saved(confirmed(estimated(pairs, sigs).where("close").select("a", "b"), docs), "near-links")
    labels = components(links)
    more = saved(left_out(edges, links.select(F.col("a").alias("center"), F.col("b").alias("node")), labels, sigs, docs), "near-more")
    named = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    between = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    above = components(between)
    final = labels.join(above.select(F.col("node").alias("component"), F.col("component").alias("_top")), "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
    lone = above.join(labels, "node", "left_anti")
    final = saved(final.unionByName(lone), "near-components")
    by_set = groups.join(final, "node", "left").withColumn("_component", F.coalesce("component", "node"))
    stands = by_set.groupBy("_component").agg(first("doc", "node").alias("_first"))
    by_set = by_set.select("set_id", "_component").join(stands, "_component").select("set_id", F.col("_first.doc").alias("_doc"), F.col("_first.row").alias("_stands"))
    out = sketch.select("doc_id", "row", "n_shingles", "set_id").join(by_set, "set_id", "left")
    alone = F.col("set_id").isNull()
    return out.select("row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("_doc")).alias("component_id"), ((alone | (F.col("row") == F.col("_stands"))) & (F.lit(unnamed) | F.col("doc_id").isNotNull())).alias("kept"))


def grouped(docs: DataFrame, unnamed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether the row stands for its component), one row per row of docs.

    unnamed: whether a row without a doc_id may be kept too, as the queries ask for.
    """
    return judged(docs, unnamed).drop("row")


def filtered(docs: DataFrame, unnamed: bool = False) -> DataFrame:
    """The kept row of each group with all columns of docs; of rows that repeat doc_id and text, one. unnamed as in grouped()."""
    names = docs.columns
    own = {c: f"_own{i}" for i, c in enumerate(names)}
    kept = judged(docs.select("doc_id", "text"), unnamed).where("kept").select(F.col("row").alias("_kept")).distinct()
    rows = docs.withColumn("_row", row_key()).toDF(*own.values(), "_row")
    left = rows.join(kept.hint("shuffle_hash"), F.col("_row") == F.col("_kept"), "left_semi")
    return left.dropDuplicates(["_row"]).drop("_row").toDF(*names)


#: The result of grouped() in DuckDB's SQL: all pairs that share a shingle, and a recursion over their links.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * same >= 75 * (na + nb - same)),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s
"""
