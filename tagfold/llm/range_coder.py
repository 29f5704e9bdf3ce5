"""Token ids in compressed files: an adaptive context-mixing range coder over independent blocks.

Ids are cut into blocks of BLOCK; each block starts from the same models and is coded on its own, so it can be read alone
with the segment's header. What is learnt inside a block, and forgotten at its end:

* order 2 and order 1: the id that last followed the same two ids, else the same last id, is asked for first (where none has
  followed, the first of all ids is, with a chance that soon is as small as it deserves). The chance of
  yes mixes, in the logistic domain with weights that adapt, how often that id has followed in a row and how frequent it is.
* order 1 and order 0: an id that isn't the asked one is coded by a mixture of two distributions, that of ids after the last
  id's class and that of all ids. Their shares follow how well each has predicted the block so far.

Classes and distributions stand in the header, counted over the segment: a block alone is too short to learn tens of
thousands of ids. A class gathers ids with similar successors. All arithmetic is in integers, so any machine reads what
another wrote. Checksums of the header and of a block's bytes are tested before either is used.

Many blocks are coded side by side, one numpy lane each. A segment is the ids of consecutive documents, written as one
binary value: header (lengths of the documents, ids, counts, classes, sizes and checksums of the blocks), then the blocks.
Segments are rows of a Parquet table, in ascending doc_id order within and across the files' partition numbers.

Defined cases: a null text is empty and has its end id only; rows that repeat a doc_id follow one another, by text; a null
doc_id comes first; a document of any length stays in one segment, which may then be longer than SEGMENT; an empty table
gives no segments and no rows; other columns, whatever they are called, play no part.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagfold.llm import tokens
from tagfold.llm.common import saved

BLOCK = 1_024
#: Ids of a segment, about: it ends with the document that reaches so many.
SEGMENT = 1 << 22
#: Bytes of texts that are tokenized together, but for longer ones.
CHUNK = 1 << 23
MAGIC = b"TGF3"
END_ID = 1
#: Slots of a block's order-2 and order-1 tables.
SLOTS2, SLOTS1 = 1_024, 512
#: Frequencies of a distribution add up to 1 << TOTAL.
TOTAL = 20
#: Bits of a value by which its place is looked up, before the last steps.
CELLS = 14
#: From which bit on an interval's start and width are kept, above another number.
START, WIDTH = 32, 8
#: Most classes of ids, and parts of successor counts that they are told apart by.
CLASSES, PARTS = 16, 128
#: Shares in 16ths of the order-1 distribution in a mixture, by how well it has done.
SHARES = (2, 7, 11, 14)
#: A pair of ids that a segment has fewer times isn't counted in its class.
LEAST_PAIRS = 2
U64 = np.uint64


def _stretch_table() -> np.ndarray:
    """ln(p / (1 - p)) in 1/256 for p in 1/4096."""
    return np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], np.int32)


def _squash_table() -> np.ndarray:
    """The inverse: a 16-bit chance for x in 1/256 from -2047 to 2047."""
    return np.array([min(65_000, max(536, round(65_536 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)


STRETCH, SQUASH = _stretch_table(), _squash_table()


def logs(n: np.ndarray) -> np.ndarray:
    """log2 of whole numbers (at least 1) in 1/16, by their leading bits."""
    e = np.frexp(n.astype(float))[1].astype(np.int64) - 1
    return 16 * e + (np.where(e >= 4, n >> np.maximum(e - 4, 0), n << np.maximum(4 - e, 0)) - 16)


def frequencies(weights: np.ndarray) -> np.ndarray:
    """Running totals from 0 to 1 << TOTAL of frequencies in proportion to the rows of weights, none of them 0."""
    k, v = weights.shape
    upto = np.cumsum(weights, axis=1)
    scaled = np.arange(1, v + 1) + upto * ((1 << TOTAL) - v) // np.maximum(upto[:, -1:], 1)
    return np.concatenate([np.zeros((k, 1), np.int64), scaled], axis=1)


@dataclass
class Model:
    """What a header knows: counts of ids (by place in its list), class of each, and counts of ids after each class."""

    counts: np.ndarray
    classes: np.ndarray
    after: np.ndarray

    def __post_init__(self) -> None:
        v, k = len(self.counts), len(self.after)
        every = (self.counts << 20) // max(int(self.counts.sum()), 1) + 1
        own = (self.after << 20) // np.maximum(self.after.sum(1, keepdims=True), 1)
        self.size, n = v + 1, k * len(SHARES)
        starts = np.empty((k, len(SHARES), self.size), np.int64)
        for i, share in enumerate(SHARES):
            starts[:, i] = frequencies(share * own + (16 - share) * every)
        starts = starts.reshape(n, self.size)
        # by how much an id after a class is likelier by its class than by itself, in 1/16 of a doubling, and 64 more
        better = np.clip(logs(own + 1) - logs(every), -64, 64) + 64
        #: Of all mixtures, one after another: [class, share, place], where the id's interval starts, how wide it is, and better.
        self.packed = starts << START
        self.packed[:, :-1] += np.diff(starts, axis=1) << WIDTH
        self.packed[:, :-1] += np.repeat(better, len(SHARES), axis=0)
        self.packed = self.packed.ravel()
        #: For each mixture and part of 0..1 << TOTAL, the last place (among all starts) that starts at or before it.
        cells = starts[:, :-1] + ((1 << TOTAL - CELLS) - 1) >> TOTAL - CELLS
        cells += np.arange(n)[:, None] * ((1 << CELLS) + 1)
        begun = np.cumsum(np.bincount(cells.ravel(), minlength=n * ((1 << CELLS) + 1))).reshape(n, -1)
        self.first = (begun + (np.arange(n) - 1)[:, None]).astype(np.int32).ravel()
        self.level = np.minimum(logs(every) // 32, 15).astype(np.int32)

    def place(self, cell: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Where among all mixtures' ids the one stands whose interval holds a value, from where the mixture's cells start."""
        cell = cell + (value >> TOTAL - CELLS)
        at = self.first.take(cell).astype(np.int64)
        value = (value + 1) << START
        todo = np.flatnonzero(self.packed.take(at + 1) < value)
        if len(todo):  # halve what the cell leaves
            value, low, high = value[todo], at[todo] + 1, self.first.take(cell[todo] + 1).astype(np.int64)
            for step in reversed(range(int((high - low).max()).bit_length())):
                next_ = np.minimum(low + (1 << step), high)
                low = np.where(self.packed.take(next_) < value, next_, low)
            at[todo] = low
        return at

    def bytes(self) -> bytes:
        return zlib.compress(self.counts.astype("<u4").tobytes() + self.classes.astype("<u1").tobytes() + self.after.astype("<u2").tobytes())

    @staticmethod
    def of(data: bytes, v: int) -> Model:
        raw = zlib.decompress(data)
        after = np.frombuffer(raw, "<u2", offset=5 * v).astype(np.int64)
        return Model(np.frombuffer(raw, "<u4", v).astype(np.int64), np.frombuffer(raw, "<u1", v, 4 * v).astype(np.int64), after.reshape(-1, v) if v else after.reshape(1, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in pieces so small that the BLAS uses one thread: its others would spin on cores that other tasks need."""
    rows = np.concatenate([a, np.zeros((-len(a) % 64, a.shape[1]), a.dtype)]).reshape(-1, 64, a.shape[1])
    return (rows @ b).reshape(-1, b.shape[1])[: len(a)]


def classed(places: np.ndarray, v: int) -> np.ndarray:
    """A class for each of v ids: ids whose successors fall alike into PARTS parts, by a few rounds of k-means."""
    if len(places) < 2:
        return np.zeros(v, np.int64)
    part = (np.arange(v) * 2_654_435_761 >> 7) % PARTS
    few = places[: -1 : max(1, len(places) >> 19)], places[1 :: max(1, len(places) >> 19)]
    n = min(map(len, few))
    table = np.bincount(few[0][:n] * PARTS + part[few[1][:n]], minlength=v * PARTS).reshape(v, PARTS).astype(np.float32)
    mass = table.sum(1)
    shape = np.sqrt(table / np.maximum(mass, 1)[:, None])
    # the first centre is the most frequent id, each next one the frequent id that is least like those before
    frequent = np.argsort(-mass, kind="stable")[: 16 * CLASSES]
    centers, like = [frequent[0]], products(shape[frequent], shape[frequent[0]][:, None])[:, 0]
    for _ in range(min(CLASSES, v) - 1):
        centers.append(frequent[np.argmin(like)])
        like = np.maximum(like, products(shape[frequent], shape[centers[-1]][:, None])[:, 0])
    middle = shape[centers]
    for _ in range(4):
        of = np.argmax(products(shape, middle.T), 1)
        sums = np.stack([np.bincount(of, weights=table[:, p], minlength=len(middle)) for p in range(PARTS)], 1)
        middle = np.sqrt(sums / np.maximum(sums.sum(1, keepdims=True), 1)).astype(np.float32)
    return np.argmax(products(shape, middle.T), 1)


def fitted(places: np.ndarray, v: int) -> Model:
    counts = np.bincount(places, minlength=v)
    classes = classed(places, v)
    k = int(classes.max(initial=0)) + 1
    before = classes[places[:-1]] if len(places) else places
    after = np.bincount(before * v + places[1:], minlength=k * v).reshape(k, v) if v else np.zeros((1, 0), np.int64)
    return Model(counts, classes, np.where(after < LEAST_PAIRS, 0, np.minimum(after, 65_535)))


def coded(blocks: int, n_ids: int, model: Model, ids: np.ndarray | None, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes ids [block, place], or reads them from words [block, word]; all blocks but the last have BLOCK ids.

    Returns the ids, the words and how many of these each block has.
    """
    n, decode = blocks, words is not None
    last_length = n_ids - (n - 1) * BLOCK
    out = np.zeros((BLOCK, n), np.int32) if decode else np.ascontiguousarray(ids.T)
    # from: the interval's lower end or, while decoding, how far above it the coded number is
    from_, wide = np.zeros(n, U64), np.full(n, 0xFFFFFFFFFFFFFFFF, U64)
    if not decode:
        words = np.zeros((n, BLOCK + 16), np.uint32)
    per = words.shape[1]
    flat, begin = words.reshape(-1), np.arange(n) * per
    at = begin + 2 * decode
    if decode:
        from_ = (words[:, 0].astype(U64) << U64(32)) | words[:, 1]
    # a slot holds the id that followed last and, in its lowest three bits, how often it did in a row (0: none has)
    # slot by slot, so that blocks with the same frequent id before them look close together
    slot2, slot1 = np.zeros(n * SLOTS2, np.int32), np.zeros(n * SLOTS1, np.int32)
    often, known = np.full((n, 16), 1 << 13, np.int32), np.full(n * 16, 1 << 13, np.int32)
    often[:, 0] = 600
    often = often.ravel()
    weight_o, weight_k = np.full(n, 40_000, np.int32), np.full(n, 10_000, np.int32)
    score, size, shares = np.zeros(n, np.int32), model.size, len(SHARES)
    rows = model.classes * (shares * size)  # where the mixtures after an id start
    cells = model.classes * (shares * ((1 << CELLS) + 1))  # and their cells
    b, hash_a, lane = np.zeros(n, np.int32), np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    at16, at24 = lane * 16, lane * 16 + 8
    for t in range(BLOCK):
        if t == last_length and n > 1:
            last = from_[-1:], at[-1:]
            n -= 1
            from_, wide, at, score, b, hash_a, lane, at16, at24, weight_o, weight_k = (x[:n] for x in (from_, wide, at, score, b, hash_a, lane, at16, at24, weight_o, weight_k))
        elif t == last_length:
            break
        hash_b = b * 40_503
        where2 = ((hash_a + b * 30_011 >> 3 & SLOTS2 - 1) * blocks + lane).astype(np.intp)
        where1 = ((hash_b >> 5 & SLOTS1 - 1) * blocks + lane).astype(np.intp)
        v2, v1 = slot2.take(where2), slot1.take(where1)
        seen = (v2 & 7) > 0
        v = np.where(seen, v2, v1)
        guess = v >> 3
        # is it the id that followed before?
        i, j = ((v & 7) + np.where(seen, at24, at16)).astype(np.intp), (model.level.take(guess) + at16).astype(np.intp)
        p, q = often.take(i), known.take(j)
        ps, qs = STRETCH.take(p >> 4), STRETCH.take(q >> 4)
        chance = SQUASH.take((ps * weight_o + qs * weight_k >> 16) + 2047, mode="clip")
        bound = (wide >> U64(16)) * chance.astype(U64)
        hit = from_ < bound if decode else guess == out[t, :n]
        goal = np.multiply(hit, 65_535, dtype=np.int32)
        error = goal - chance
        often[i], known[j] = p + (goal - p >> 4), q + (goal - q >> 5)
        weight_o += ps * error >> 14
        weight_k += qs * error >> 14
        # if not, which one?
        share = np.minimum(np.maximum(score + 256 >> 7, 0), shares - 1)
        row = rows.take(b) + share * size
        unit = (wide - bound) >> U64(TOTAL)
        if decode:
            # above // unit: of floats and a little more, so that the quotient is right or one too many
            above = from_ - bound
            value = (above.astype(float) / unit.astype(float) + 2**-20).astype(np.int64)
            value -= above < unit * value.astype(U64)
            value = np.where(hit, 0, np.minimum(value, (1 << TOTAL) - 1))
            x = out[t, :n] = np.where(hit, guess, model.place(cells.take(b) + share * ((1 << CELLS) + 1), value) - row)
        else:
            x = out[t, :n]
        both = model.packed.take(row + x)
        add = unit * (both >> START).astype(U64)
        wide = np.where(hit, bound, unit * ((both & (1 << START) - 1) >> WIDTH).astype(U64))
        score += np.where(hit, 0, (both.astype(np.int32) & (1 << WIDTH) - 1) - 64) - (score >> 4)
        if decode:
            from_ = np.where(hit, from_, above - add)
        else:
            before = from_
            from_ = before + np.where(hit, U64(0), bound + add)
            if len(carry := np.flatnonzero(from_ < before)):
                carry = at[carry]
                while len(carry):
                    carry = carry - 1
                    flat[carry] += np.uint32(1)
                    carry = carry[flat[carry] == 0]
        # every interval is at least 32 bits wide: else its leading word goes, once is enough
        small = np.flatnonzero(wide < U64(1 << 32))
        w, some = at[small], from_[small]
        if decode:
            from_[small] = (some << U64(32)) | flat.take(w, mode="clip")
        else:
            flat[w] = some >> U64(32)
            from_[small] = some << U64(32)
        wide[small] <<= U64(32)
        at[small] = w + 1
        # what was seen becomes the next prediction
        plain = x << 3
        most = plain + 7
        slot2[where2] = np.where(v2 ^ plain < 8, np.minimum(v2 + 1, most), plain + 1)
        slot1[where1] = np.where(v1 ^ plain < 8, np.minimum(v1 + 1, most), plain + 1)
        hash_a, b = hash_b, x
    if n < blocks:
        from_, at = (np.concatenate(x) for x in zip((from_, at), last))
    if not decode:  # the interval's lower end
        flat[at], flat[at + 1] = from_ >> U64(32), from_ & U64(0xFFFFFFFF)
        at = at + 2
    return out.T, words, at - begin


def encode(places: np.ndarray, model: Model) -> list[bytes]:
    """The blocks of places in the model's list of ids."""
    n = -(-len(places) // BLOCK)
    if not n:
        return []
    padded = np.zeros(n * BLOCK, np.int32)
    padded[: len(places)] = places
    _, words, sizes = coded(n, len(places), model, padded.reshape(n, BLOCK))
    return [w[:size].astype("<u4").tobytes() for w, size in zip(words, sizes)]


def decode(blocks: list[bytes], model: Model, n_ids: int) -> np.ndarray:
    """What encode() was given, from some of its blocks that have n_ids ids: only the last may have fewer than BLOCK."""
    n = len(blocks)
    if not n:
        return np.empty(0, np.int32)
    words = np.zeros((n, max(map(len, blocks)) // 4 + 2), np.uint32)
    for i, x in enumerate(blocks):
        words[i, : len(x) // 4] = np.frombuffer(x, "<u4")
    return coded(n, n_ids, model, None, words)[0].ravel()[:n_ids]


def listed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, in order, and the place of each of ids among them."""
    if ids.max(initial=0) >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    there = np.bincount(ids) > 0
    return np.flatnonzero(there).astype(ids.dtype), (np.cumsum(there, dtype=np.int32) - np.int32(1)).take(ids)


def segment(documents: list[bytes]) -> bytes:
    """One segment of documents' ids (little-endian unsigned 32-bit)."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    known, places = listed(ids)
    fit = fitted(places, len(known))
    blocks, model = encode(places, fit), fit.bytes()
    names = zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes())
    head = MAGIC + struct.pack("<QQIIIII", len(documents), len(ids), BLOCK, len(blocks), len(known), len(names), len(model))
    fixed = head + np.array([len(d) // 4 for d in documents], "<u8").tobytes() + names + model + np.array([len(x) for x in blocks], "<u4").tobytes() + np.array([zlib.crc32(x) for x in blocks], "<u4").tobytes()
    return fixed + struct.pack("<I", zlib.crc32(fixed)) + b"".join(blocks)


@dataclass
class Header:
    lengths: np.ndarray
    ids: np.ndarray
    model: Model
    starts: np.ndarray  # of blocks, and the end
    checks: np.ndarray
    n_ids: int


def header_of(data: bytes) -> Header:
    """The header of a segment; raises ValueError if its checksum doesn't hold."""
    n_docs, n_ids, block, n_blocks, n_known, n_names, n_model = struct.unpack_from("<QQIIIII", data.ljust(40, b"\0"), 4)
    names = 40 + 8 * n_docs
    index = names + n_names + n_model
    end = index + 8 * n_blocks
    if data[:4] != MAGIC or block != BLOCK or len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[:end]):
        raise ValueError("not a segment, or its header is damaged")
    sizes, checks = np.frombuffer(data, "<u4", 2 * n_blocks, index).reshape(2, -1).astype(np.int64)
    ids = np.cumsum(np.frombuffer(zlib.decompress(data[names : names + n_names]), "<u4").astype(np.int64)).astype("<u4")
    return Header(np.frombuffer(data, "<u8", n_docs, 40).astype(np.int64), ids, Model.of(data[names + n_names : index], n_known), end + 4 + np.r_[0, np.cumsum(sizes)], checks, n_ids)


def block_bytes(data: bytes, head: Header, i: int) -> bytes:
    """A block as it was coded; raises ValueError if its checksum doesn't hold."""
    found = data[head.starts[i] : head.starts[i + 1]]
    if zlib.crc32(found) != head.checks[i]:
        raise ValueError(f"block {i} is damaged")
    return found


def read_block(data: bytes, i: int, head: Header | None = None) -> np.ndarray:
    """The ids of block i of a segment, from its header and this block alone."""
    head = head or header_of(data)
    return head.ids[decode([block_bytes(data, head, i)], head.model, min(BLOCK, head.n_ids - i * BLOCK))]


def documents_of(data: bytes) -> list[bytes]:
    """The ids of each document of a segment; raises ValueError if a checksum doesn't hold, before anything is decoded."""
    head = header_of(data)
    blocks = [block_bytes(data, head, i) for i in range(len(head.checks))]
    ids = head.ids[decode(blocks, head.model, head.n_ids)].tobytes()
    cuts = np.r_[0, np.cumsum(head.lengths)] * 4
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def written(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encodes docs and writes their segments: part, n_before (ids before it in its part), n_ids, doc_ids and data of each."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n_before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tokens.encoder(tokenizer_path), TaskContext.get().partitionId()
        names, ids, size, before = [], [], 0, 0

        def row() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([names]), pa.array([segment(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for b in batches:
            upto, i = np.cumsum(pc.binary_length(b.column(1)).to_numpy(), dtype=np.int64), 0
            while i < b.num_rows:
                some = max(int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK, "right")) - i, 1)
                rows, i = b.slice(i, some), i + some
                for name, x in zip(rows.column(0).to_pylist(), enc.encode_column(rows.column(1))):
                    names.append(name)
                    ids.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= SEGMENT:
                        yield row()
                        names, ids, size, before = [], [], 0, before + size
        if names:
            yield row()

    in_order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_text")
    return saved(in_order.mapInArrow(run, schema), "token-segments")


def read(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with_ids, ids of each document, from what written() wrote."""
    kind = segments.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("_at", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), *[T.StructField("ids", T.BinaryType())] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, names, data in zip(*(b.column(i) for i in range(4))):
                ids = documents_of(data.as_py())
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                columns = [pa.array([part.as_py()] * len(ids), pa.int32()), names.values, pa.array(before.as_py() + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * with_ids], names=schema.names)

    # one number for each part, as many as the write had tasks: small, and broadcast so that segments are decoded once
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    rows = segments.select("part", "n_before", "doc_ids", "data").mapInArrow(run, schema)
    return rows.join(F.broadcast(parts), F.col("part") == F.col("_part")).select("doc_id", (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
