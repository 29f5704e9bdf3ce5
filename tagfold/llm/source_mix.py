"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents are shuffled into one stream of words, cut into blocks of equal size. The points of a golden-ratio
sequence, mapped through the cumulative target shares, name the source of each slot; the slots of a source are ranked and
the slot of rank r takes block r of the source's stream, which starts anew when it ends. A source's last slot is cut where
its target is reached, and a source that the sequence has left short by a few slots gets them at the end, so each source
gives its rounded target exactly. What the schedule decides is when: a document's first_slot is the place of the first
block that takes words of it, and mixed() writes the mix in the order of slots, sources interleaved as the points say.

Defined cases: a null text has size 0 and is taken 0 times; null is a source of its own, the last one; repeated rows are
each mixed; a source without words has the target 0; texts of any length are counted whole and may lie in many blocks; ties
of the shuffle go by doc_id and size; an empty table gives no rows; extra columns of any name are left alone. Reruns give
the same result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagfold.llm.common import WORD, running_total, saved

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words to mix as a share of all words, and most passes over a source.
BUDGET_PERCENT, MOST_PASSES = 150, 2
#: floor(2 ** 32 / golden ratio): t * GOLDEN mod 2 ** 32 runs through all 32-bit numbers.
GOLDEN = 2_654_435_769
#: Blocks in all, about; a block has LEAST_BLOCK to MOST_BLOCK words.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 1 << 20, 64, 4_096
#: Equal parts of 0..1 in which the shares of the sources are looked up.
CELLS = 4_096
#: Rows that share one bucket of a stream or of the schedule, about.
PER_BUCKET = 4_096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of a document's place in the shuffled stream of its source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def golden(t: Column) -> Column:
    """The t-th point of the sequence in 0..1, in integers that don't overflow."""
    low, high = t.bitwiseAND(F.lit(0xFFFF)), F.shiftright(t, 16).bitwiseAND(F.lit(0xFFFF))
    return F.pmod(F.pmod(high * F.lit(GOLDEN), F.lit(1 << 32)) * F.lit(1 << 16) + low * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds target, words (the target as a whole number) and n (0, 1, ...).

    A target is the smaller of twice the source's size and its weight times a level; the level is where all targets add
    up to the budget: the same as giving the excess of full sources to the others by weight until none is above.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("n"), F.lit(len(WEIGHTS))) + 1)
    s = sizes.withColumn("n", F.row_number().over(in_order) - 1).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * MOST_PASSES)
    full_first = Window.orderBy(F.col("_cap") / F.col("_w"), "n")
    upto, every = full_first.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"_budget": F.sum("source_size").over(every) * BUDGET_PERCENT / 100, "_full": F.coalesce(F.sum("_cap").over(upto), F.lit(0)), "_left": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0))})
    s = s.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_left"))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(every))
    return s.withColumn("target", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")))).withColumn("words", F.least(F.floor(F.col("target") + 0.5), F.col("_cap"))).select("source", "source_size", "target", "words", "n")


def schedule(plan: DataFrame, block: int, total: int) -> DataFrame:
    """A row for each slot that is used: n (the source), rank, slot (its place), first and last word of the unrolled stream.

    plan: (n, words); block: words in a block; total: the sum of words.
    """
    slots = -(-total // block) + 1
    by_share = Window.orderBy("n")
    shares = plan.withColumns({"_to": F.sum("words").over(by_share) / F.lit(float(max(total, 1))), "_need": F.ceil(F.col("words") / F.lit(block))})
    shares = shares.withColumn("_from", F.coalesce(F.lag("_to").over(by_share), F.lit(0.0))).where("words > 0").select("n", "words", "_need", "_from", "_to")
    # the source whose share holds a point: both are dealt to equal parts of 0..1, where few shares are
    cell = lambda u: F.floor(u * CELLS)
    shares_in = shares.select("n", "_from", "_to", F.explode(F.sequence(cell(F.col("_from")), F.least(cell(F.col("_to")), F.lit(CELLS - 1)))).alias("_cell"))
    point = plan.sparkSession.range(slots).select(F.col("id").alias("slot"), golden(F.col("id") + 1).alias("_u"), F.shiftright(F.col("id"), 12).alias("_bucket"))
    drawn = point.withColumn("_cell", cell(F.col("_u"))).join(shares_in, "_cell").where("_from <= _u and _u < _to").select("slot", "_bucket", "n", F.lit(1).alias("_one"))
    ranked = running_total(drawn, ["n"], "_bucket", [F.col("slot")], "_one", "rank").select("n", "rank", "slot")
    had = drawn.groupBy("n").agg(F.count("*").alias("_had"))
    short = shares.join(had, "n", "left").select("n", F.coalesce("_had", F.lit(0)).alias("_had"), "_need").where("_had < _need").select("n", F.explode(F.sequence(F.col("_had"), F.col("_need") - 1)).alias("rank"))
    short = short.select("n", "rank", (F.lit(slots) + F.col("rank")).alias("slot"))
    used = ranked.unionByName(short).join(shares.select("n", "words", "_need"), "n").where(F.col("rank") < F.col("_need"))
    return used.select("n", "rank", "slot", (F.col("rank") * block).alias("first"), F.least((F.col("rank") + 1) * block, "words").alias("last"))


def mix(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row per row of docs: keep's columns, size, source_size, target, taken, taken_again, first_slot, again_slot (null: none).

    docs has doc_id, source and size; keep may name any of its columns but those that are added. taken counts the words of
    all passes, taken_again those of the second one; first_slot is the first slot that takes any, again_slot that of the second pass.
    """
    rows = saved(docs.select(*dict.fromkeys([*keep, "doc_id", "source", "size"]), shuffle_key(F.col("doc_id")).alias("_at")), "mix-sizes")
    plan = saved(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    n_rows, total = rows.count(), plan.agg(F.sum("words")).first()[0] or 0
    block = max(LEAST_BLOCK, min(MOST_BLOCK, -(-total // BLOCKS)))
    buckets = max(1, n_rows // PER_BUCKET)
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / F.lit(float(1 << 60)) * F.lit(buckets)))
    rows = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = saved(running_total(rows, ["n"], "_bucket", [F.col("_at"), F.col("doc_id"), F.col("size")], "size", "_start"), "mix-streams")
    # where a document lies in the unrolled stream, once for each pass, and which blocks hold it there
    full = placed.where("size > 0")
    end = F.least(F.col("_from") + F.col("size"), F.col("words"))
    passes = full.select("n", "_start", "size", "words", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1)), lambda k: F.col("_start") + k * F.col("source_size"))).alias("_from"))
    parts = passes.where("_from < words").select("n", "_start", "_from", end.alias("_end"), F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((end - 1) / block))).alias("rank"))
    taken = F.least("_end", "last") - F.greatest("_from", "first")
    second = F.col("_from") > F.col("_start")
    got = parts.join(schedule(plan.select("n", "words"), block, total), ["n", "rank"]).groupBy("n", "_start").agg(
        F.sum(taken).alias("taken"), F.sum(F.when(second, taken).otherwise(0)).alias("taken_again"), F.min("slot").alias("first_slot"), F.min(F.when(second, F.col("slot"))).alias("again_slot"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    shown = [*keep, "size", "source_size", "target"]
    used = full.join(got, ["n", "_start"], "left").select(*shown, F.coalesce("taken", zero).alias("taken"), F.coalesce("taken_again", zero).alias("taken_again"), "first_slot", "again_slot")
    return used.unionByName(placed.where("size = 0").select(*shown, zero.alias("taken"), zero.alias("taken_again"), none.alias("first_slot"), none.alias("again_slot")))


def named(docs: DataFrame, own: dict[str, str]) -> DataFrame:
    """docs with its columns renamed as own says and _row, which names each row: by file and place, if docs reads Parquet
    files as they are; other rows are written first, with a number."""
    try:
        place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
        return docs.select(*(F.col(f"`{c}`").alias(o) for c, o in own.items()), place.alias("_row"))
    except AnalysisException:
        return saved(docs.toDF(*own.values()).withColumn("_row", F.monotonically_increasing_id().cast("string")), "mix-texts")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each document and pass that gives words, in the order of their slots.

    Partitions are ranges of slots, and rows in them follow the schedule. A document of which the mix takes only the first words is cut after these (white space between them becomes blanks),
    and n_chars, if there is one, counts the characters that stay.
    """
    names = docs.columns
    own = {c: f"_own{i}" for i, c in enumerate(names)}
    rows = named(docs, own)
    text = F.col(own["text"])
    sized = rows.select("_row", F.col(own["doc_id"]).alias("doc_id"), F.col(own["source"]).alias("source"), size_of(text).alias("size"))
    passes = F.array(F.struct((F.col("taken") - F.col("taken_again")).alias("words"), F.col("first_slot").alias("slot")), F.struct(F.col("taken_again").alias("words"), F.col("again_slot").alias("slot")))
    took = mix(sized, ["_row"]).select("_row", "size", F.explode(passes).alias("_pass")).select("_row", "size", F.col("_pass.words").alias("_words"), F.col("_pass.slot").alias("_slot")).where("_words > 0")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("_words") < F.col("size"), F.array_join(F.slice(words, 1, F.col("_words").cast("int")), " ")).otherwise(text)
    out = rows.join(took, "_row").withColumn(own["text"], cut)
    if "n_chars" in own:
        out = out.withColumn(own["n_chars"], F.length(own["text"]).cast(docs.schema["n_chars"].dataType))
    return out.repartitionByRange("_slot", "_row").sortWithinPartitions("_slot", "_row").select(*own.values()).toDF(*names)


#: The result of mix() in DuckDB's SQL: streams, golden points, the slots that they give each source and the blocks in these.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
c AS (SELECT *, [3, 1, 2][(n % 3 + 1)::INT] AS w, source_size * 2 AS cap FROM w),
f AS (
  SELECT *, sum(source_size) OVER () * 150 / 100 AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM c),
l AS (SELECT *, (budget - before) / rest AS own FROM f),
g AS (SELECT *, max(CASE WHEN own * w <= cap THEN own END) OVER () AS level FROM l),
t AS (SELECT source, n, source_size, cap, least(cap::DOUBLE, coalesce(level * w, cap::DOUBLE)) AS target FROM g),
k AS (SELECT *, least(floor(target + 0.5)::BIGINT, cap)::BIGINT AS words FROM t),
b AS (SELECT total, greatest(64, least(4096, (total + 1048575) // 1048576))::BIGINT AS block FROM (SELECT sum(words)::BIGINT AS total FROM k)),
h AS (
  SELECT n, words, block, (words + block - 1) // block AS need, (sum(words) OVER (ORDER BY n))::DOUBLE / greatest(total, 1) AS upto,
         coalesce((sum(words) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE / greatest(total, 1), 0) AS since
  FROM k, b),
u AS (SELECT slot, ((slot + 1) * 2654435769 % 4294967296) / 4294967296.0::DOUBLE AS u, slots FROM (SELECT unnest(range((total + block - 1) // block + 1)) AS slot, (total + block - 1) // block + 1 AS slots FROM b)),
z AS (SELECT n, slot, row_number() OVER (PARTITION BY n ORDER BY slot) - 1 AS rank FROM u JOIN h ON since <= u AND u < upto AND words > 0),
m AS (SELECT h.n, need, slots, (SELECT count(*) FROM z WHERE z.n = h.n) AS had FROM h, (SELECT max(slots) AS slots FROM u)),
y AS (SELECT n, slot, rank FROM z UNION ALL SELECT n, slots + rank, rank FROM (SELECT n, slots, unnest(range(had, need)) AS rank FROM m WHERE had < need)),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d),
q AS (
  SELECT p.doc_id, p.size, k.source_size, k.target, k.n, block,
         (greatest(0, least(start + p.size, words) - start) + greatest(0, least(start + p.size + k.source_size, words) - start - k.source_size))::BIGINT AS taken,
         CASE WHEN start < words AND p.size > 0 THEN start END AS a, least(start + p.size, words) AS a_end,
         CASE WHEN start + k.source_size < words AND p.size > 0 THEN start + k.source_size END AS e, least(start + p.size + k.source_size, words) AS e_end
  FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source, b)
SELECT doc_id, size, source_size, target, taken,
       (SELECT min(slot) FROM y WHERE y.n = q.n AND (rank BETWEEN a // block AND (a_end - 1) // block OR rank BETWEEN e // block AND (e_end - 1) // block))::BIGINT AS first_slot
FROM q
"""
