"""Best-fit packing by bin completion.

Documents are encoded and, where longer than a sequence, cut into pieces. How pieces fill sequences depends on their
lengths only, so the driver plans on the histogram of lengths, at most one number for each length, by branch and bound:
around the largest piece left every filling that no other dominates is a branch, those that waste least first, and each is
taken as often as the histogram allows or once. A branch ends when what it used and the lower bound of what is left don't
beat the best plan so far; best-fit decreasing gives the first such plan. The search backtracks until no branch is left,
the plan meets the lower bound, or STEPS steps are done; only then may a better plan exist. Spark then ranks the pieces of
each length and looks up rank by rank which sequence of the plan has them.

Defined cases: a null text is empty and packs as its end id alone; repeated rows are each packed; an empty table gives no
rows; other columns, whatever they are called, play no part; equal lengths go by a hash and then doc_id and piece. A text of any length is encoded whole and cut into as many pieces as it needs.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagfold.llm import tokens
from tagfold.llm.common import running_total, saved

CAPACITY, END_ID = 1_024, 2
CHUNK = 256
#: Steps that the search for a plan may take in all.
STEPS = 20_000
#: Pieces of one length that share a bucket, about.
PER_BUCKET = 4_096

PIECE = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than a sequence."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with_ids, ids (little-endian unsigned 32-bit) of each piece of docs."""
    schema = T.StructType([docs.schema["doc_id"], *PIECE, *[T.StructField("ids", T.BinaryType())] * with_ids])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer_path)
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                ids = [x + end for x in enc.encode(b.column(1).slice(i, CHUNK).to_pylist())]
                rows = [(k, j, s, n, x[4 * s : 4 * (s + n)]) for k, x in enumerate(ids) for j, (s, n) in enumerate(cut(len(x) // 4, capacity))]
                of, piece, start, length, part = zip(*rows)
                columns = [b.column(0).slice(i, CHUNK).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in part], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(part, pa.binary())] * with_ids], names=schema.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, schema)


Plan = list[tuple[tuple[int, ...], int]]  # lengths in one sequence, largest first; number of such sequences


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing on a histogram: each length goes to the fullest sequences that still take it."""
    open_: dict[int, list[list]] = {}  # room left -> [lengths, number]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, bins in open_.items() if r >= length and bins), default=None)
            if room is None:
                each = min(capacity // length, left)
                n = left // each
                open_.setdefault(capacity - each * length, []).append([(length,) * each, n])
                left -= each * n
                continue
            lengths, n = open_[room].pop()
            each = min(room // length, left)
            use = min(n, left // each)
            if use < n:
                open_[room].append([lengths, n - use])
            open_.setdefault(room - each * length, []).append([lengths + (length,) * each, use])
            left -= each * use
    return [(tuple(lengths), n) for bins in open_.values() for lengths, n in bins]


def sums(counts: dict[int, int], sizes: list[int], capacity: int, known: list[int], start: int) -> None:
    """Brings known up to date from start on: bit x of known[i] tells whether pieces of sizes[:i] can fill x."""
    del known[start + 1 :]
    can, within = known[-1], (2 << capacity) - 1
    for s in sizes[start:]:
        n, k = min(counts[s], capacity // s), 1
        while n:
            k = min(k, n)
            can |= can << (s * k)
            n, k = n - k, 2 * k
        can &= within
        known.append(can)


def exact(target: int, counts: dict[int, int], sizes: list[int], known: list[int], upto: int) -> Iterator[tuple[int, ...]]:
    """The fillings of target by pieces of sizes[:upto], those with the largest pieces first; known leads past dead ends."""
    if not target:
        yield ()
        return
    for i in range(bisect_right(sizes, target, 0, upto) - 1, -1, -1):
        if not known[i + 1] >> target & 1:
            return
        size = sizes[i]
        for k in range(min(counts[size], target // size), 0, -1):
            if known[i] >> (target - k * size) & 1:
                for rest in exact(target - k * size, counts, sizes, known, i):
                    yield (size,) * k + rest


def dominated(used: tuple[int, ...], waste: int, spare: int) -> bool:
    """Whether some filling of the same room is at least as good as used in any plan; bit x of spare: a piece of x is left over.

    So it is if a piece that is left can take the place of smaller ones that add up to no more, within the room.
    """
    one = two = 0  # sums of at least one and of at least two of the pieces
    single = 0
    for s in used:
        two |= one << s
        one |= one << s | 1 << s
        single |= 1 << s
    near, wide = two, 1
    more, single = single << 1, single << 1
    # a sum of several is matched by a piece of its length up to waste more, a single one by a larger piece
    while wide <= waste:
        step = min(wide, waste + 1 - wide)
        near |= near << step
        wide += step
    for _ in range(waste):
        if more & spare:
            return True
        more <<= 1
    return bool(near & spare)


def fillings(room: int, counts: dict[int, int], sizes: list[int], known: list[int]) -> Iterator[tuple[int, ...]]:
    """All fillings of room by pieces of counts that none dominates, least waste first; to none of them another piece could be added."""
    there = sum(1 << s for s in sizes if counts[s])
    for waste in range(room + 1):
        if known[-1] >> (room - waste) & 1:
            for used in exact(room - waste, counts, sizes, known, len(sizes)):
                spare = there
                for s in set(used):
                    if counts[s] == used.count(s):
                        spare ^= 1 << s
                if not spare & ((2 << waste) - 1) and not dominated(used, waste, spare):
                    yield used


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any plan needs: those of pieces that can't share one, and what else doesn't fit beside them (Martello and Toth's L2)."""
    n, size = [0] * (capacity + 2), [0] * (capacity + 2)  # of pieces of at least a length
    for s in range(capacity, -1, -1):
        n[s], size[s] = n[s + 1] + counts.get(s, 0), size[s + 1] + s * counts.get(s, 0)
    half, most = capacity // 2 + 1, 0
    for k in range(half):
        large, middle = n[capacity - k + 1], n[half] - n[min(capacity - k + 1, capacity + 1)]
        room = middle * capacity - (size[half] - size[capacity - k + 1])
        most = max(most, large + middle + max(0, math.ceil((size[k] - size[half] - room) / capacity)))
    return most


def choices(top: int, counts: dict[int, int], sizes: list[int], capacity: int, known: list[int], start: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Branches of a step: the lengths of a sequence with the largest piece top, and how many such sequences."""
    counts = {**counts, top: counts[top] - 1}
    sums(counts, sizes, capacity, known, start)
    for used in fillings(capacity - top, counts, sizes, known):
        lengths = (top, *used)
        most = min((counts[s] + (s == top)) // lengths.count(s) for s in set(lengths))
        yield lengths, most
        if most > 1:
            yield lengths, 1


def search(counts: dict[int, int], capacity: int, best: Plan, most_steps: int = STEPS) -> Plan:
    """Branch and bound for a plan of fewer sequences than best.

    Branches that depart least from the first choices come first, of these the last ones; a step's other choices are made
    when they are asked for.
    """
    least, most = lower_bound(counts, capacity), sum(n for _, n in best)
    todo: list[tuple] = [(0, 0, None, 0)]  # departures, number, branch: (earlier branch, lengths, number of sequences), choice
    steps = pushed = 0
    while todo and most > least and steps < most_steps:
        departures, _, branch, k = heapq.heappop(todo)
        left, used = dict(counts), 0
        for lengths, n in path(branch):
            for s in lengths:
                left[s] -= n
            used += n
        sizes, known, start = sorted(s for s, n in left.items() if n), [1], 0
        while sizes and steps < most_steps and used + lower_bound(left, capacity) < most:
            steps += 1
            choice = next(islice(choices(sizes[-1], left, sizes, capacity, known, start), k, None), None)
            if choice is None:
                break
            pushed += 1
            heapq.heappush(todo, (departures + 1, -pushed, branch, k + 1))
            lengths, n = choice
            branch, k, used = (branch, lengths, n), 0, used + n
            for s in lengths:
                left[s] -= n
            start = bisect_left(sizes, min(lengths))
            sizes = [s for s in sizes if left[s]]
        if not sizes and used < most:
            best, most = path(branch), used
    return best


def path(branch: tuple | None) -> Plan:
    """The steps that lead to a branch, first ones first."""
    steps = []
    while branch:
        branch, lengths, n = branch
        steps.append((lengths, n))
    return steps[::-1]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """How to fill as few sequences as can be found; counts: pieces of each length from 1 to capacity."""
    counts = {s: n for s, n in counts.items() if n}
    whole = counts.pop(capacity, 0)  # these fill a sequence each, whatever becomes of the others
    return [((capacity,), whole)] * bool(whole) + search(counts, capacity, best_fit(counts, capacity))


def lookup(spark, best: Plan, capacity: int = CAPACITY) -> DataFrame:
    """Which sequence has the pieces of a length by rank: rows (length, from_rank, to_rank, each, first_sequence, first_offset).

    Pieces from_rank to to_rank - 1 go, each of them to a sequence, to first_sequence and the following ones.
    """
    rows, taken, sequence = [], {}, 0
    for lengths, n in best:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            each, lo = lengths.count(size), taken.get(size, 0)
            rows.append((size, lo, lo + each * n, each, sequence, offset))
            taken[size] = lo + each * n
            offset += each * size
        sequence += n
    return spark.createDataFrame(rows, "length long, from_rank long, to_rank long, each long, first_sequence long, first_offset long")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length and any more columns, none of them starting with _) with sequence_id and offset.

    parts is read several times: give it saved.
    """
    # one number for each length, at most capacity in all
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(counts.values()) // PER_BUCKET)
    table = lookup(parts.sparkSession, plan(counts, capacity), capacity)
    ranked = running_total(parts.withColumns({"_bucket": F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)), "_one": F.lit(1)}), ["length"], "_bucket", [F.col("doc_id"), F.col("piece")], "_one", "_rank")
    # the lookup table is bounded by the capacity, whatever the number of pieces
    found = ranked.join(F.broadcast(table.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank")))
    at = F.col("_rank") - F.col("from_rank")
    return found.select(*parts.columns, (F.col("first_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("first_offset") + F.pmod(at, F.col("each")) * F.col("length")).alias("offset"))


def packed(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all pieces of docs."""
    return pack(saved(pieces(docs, tokenizer_path), "pieces"))


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_ids and ids; for pieces made with_ids. Each holds at most a capacity of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed_with_ids.groupBy("sequence_id").agg(parts.alias("_p"), F.sum("length").alias("n_ids")).select("sequence_id", "n_ids", F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
