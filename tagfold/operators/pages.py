"""The page store as a fold of its command log: SAVE, LOAD, TEST, TOUCH, REMOVE and CLEAN.

A page's expiration depends on what it was before (touches and reads lengthen what is left), so each page's commands are
folded in order, as sessions are: partitions are sorted by page and sequence number and folded as they stream past, one
page at a time. CLEAN concerns all pages: every partition gets the CLEANs before its pages, and each save is followed by a
search for the first of them that takes the page, so pages don't meet all CLEANs. A CLEAN of old pages looks at all of them
(each user-agent class keeps its retain count): folds of the whole log, in rounds, find which expired pages it leaves.

Rows of a log: seq, ts, id, ua, op, lifetime (SAVE: requested, TOUCH: extra), tags, usize and mode (CLEAN). Null tags are
none; a null tag in a list is dropped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagfold.functions import lifetimes as L
from tagfold.functions.lifetimes import by_ua
from tagfold.operators.tags import UNTAGGED, own
from tagfold.ship import ship

COLUMNS = ["seq", "ts", "id", "ua", "op", "lifetime", "tags", "usize", "mode"]
STATE = "id string, ua int, tags array<string>, mtime long, expire long, lru_seq long, usize long, loads long, hits long, errors long, alive boolean"
NAMES = [x.split()[0] for x in STATE.split(", ")]
#: Rows of a fold: pages' states, and what decides on CLEANs of old pages.
MARKED = f"{STATE}, mark string, seq long, n long, until long"
MARKS = [x.split()[0] for x in MARKED.split(", ")]
TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in MARKED.split(", ")]
ROWS = ["kind", "id", "seq", "ts", "ua", "op", "lifetime", "tags", "usize", "mode", "seqs", "tss", "lru_seqs", "ids", "state"]
#: Before all sequence numbers; -NEVER is after them.
NEVER = -(1 << 62)


class Page:
    """State of one page; apply() follows one command."""

    __slots__ = ("alive", "ua", "tags", "mtime", "expire", "lru_seq", "usize", "loads", "hits", "errors")

    def __init__(self) -> None:
        self.loads = self.hits = self.errors = 0
        self.drop()

    def drop(self) -> None:
        self.alive, self.ua, self.tags, self.mtime, self.expire, self.lru_seq, self.usize = False, 0, [], 0, 0, 0, 0

    def apply(self, seq: int, ts: int, ua: int, op: str, lifetime: int | None, tags: list[str], usize: int | None, always: bool) -> None:
        """always: every read lengthens the lifetime (LRU modes), else only that of an expired page."""
        if op == "SAVE":
            self.ua = max(self.ua, ua)
            asked = -1 if lifetime is None else lifetime
            most, default = L.FPC_MAX[self.ua], L.FPC_DEFAULT[self.ua]
            self.alive, self.tags, self.mtime, self.lru_seq, self.usize = True, list(dict.fromkeys(tags)), ts, seq, usize or 0
            self.expire = L.INFINITE if asked == 0 else ts + min(default if asked < 0 or asked == L.INFINITE else asked, most)
        elif op in ("LOAD", "TEST"):
            self.loads += 1
            if self.alive:
                self.hits += 1
                self.ua, self.lru_seq = max(self.ua, ua), seq
                if self.expire != L.INFINITE and (always or ts >= self.expire):
                    self.expire = max(self.expire, ts + L.FPC_READ_EXTRA[self.ua])
        elif op == "TOUCH":
            if not self.alive:
                self.errors += 1  # did not exist
            else:
                self.lru_seq = seq
                if self.expire != L.INFINITE:
                    self.expire = ts + min((lifetime or 0) + max(self.expire - ts, 0), L.FPC_MAX[self.ua])
        elif op == "REMOVE":
            self.drop()
        else:
            raise ValueError(f"the page fold has no rule for {op}")

    def clean(self, mode: str, tags: set[str]) -> None:
        has = set(self.tags) or {UNTAGGED}
        if mode == "all" or mode == "matchall" and tags and tags <= has or mode == "matchany" and tags & has or mode == "matchnot" and not tags & has:
            self.drop()

    def row(self, name: str) -> tuple:
        return name, self.ua, self.tags, self.mtime, self.expire, self.lru_seq, self.usize, self.loads, self.hits, self.errors, self.alive


class Cleans:
    """The CLEANs of a log: first() finds the one that takes a page with given tags, without a look at the others.

    Tags stay as they are from a save to the next, so one search for each save is enough. It takes a bisection for each of
    the page's tags (matchany) and each different list of tags that it has whole (matchall). For matchnot it starts from
    the next one and skips, tag by tag, runs of neighbours that name a tag of the page.
    """

    def __init__(self, given: list[tuple[str, tuple[str, ...], list[int]]]) -> None:
        """given: mode, tags and sequence numbers."""
        self.all, self.any, whole, nots = [], defaultdict(list), defaultdict(list), []
        for mode, tags, seqs in given:
            if mode == "all":
                self.all += seqs
            elif mode == "matchany":
                for t in tags:
                    self.any[t] += seqs
            elif mode == "matchall" and tags:
                whole[frozenset(tags)] += seqs
            elif mode == "matchnot":
                nots += [(seq, tags) for seq in seqs]
        for found in (self.all, *self.any.values(), *whole.values()):
            found.sort()
        # each list of tags is kept under that of its tags which the fewest lists have
        count = Counter(t for tags in whole for t in tags)
        self.whole = defaultdict(list)
        for tags, seqs in whole.items():
            self.whole[min(tags, key=lambda t: (count[t], t))].append((tags, seqs))
        nots.sort()
        self.nots, places = [seq for seq, _ in nots], defaultdict(list)
        for i, (_, tags) in enumerate(nots):
            for t in tags:
                places[t].append(i)
        # starts and ends of the runs of neighbours with a tag
        self.runs = {}
        for t, at in places.items():
            starts = [i for k, i in enumerate(at) if not k or at[k - 1] != i - 1]
            ends = [i + 1 for k, i in enumerate(at) if k + 1 == len(at) or at[k + 1] != i + 1]
            self.runs[t] = (starts, ends)
        self.lists = lru_cache(1 << 12)(self._lists)

    def _lists(self, has: frozenset[str]) -> list[list[int]]:
        found = [self.all, *(self.any[t] for t in has if t in self.any)]
        found += [seqs for t in has if t in self.whole for tags, seqs in self.whole[t] if tags <= has]
        return [x for x in found if x]

    def first(self, tags: list[str], since: int) -> float:
        """Sequence number of the first CLEAN from since on that takes a page with these tags; infinite if none does."""
        has = frozenset(tags) or frozenset([UNTAGGED])
        best = float("inf")
        for seqs in self.lists(has):
            k = bisect_left(seqs, since)
            if k < len(seqs) and seqs[k] < best:
                best = seqs[k]
        runs = [self.runs[t] for t in has if t in self.runs]
        i = bisect_left(self.nots, since)
        moved = True
        while moved and i < len(self.nots) and self.nots[i] < best:
            moved = False
            for starts, ends in runs:
                k = bisect_right(starts, i) - 1
                if k >= 0 and i < ends[k]:
                    i, moved = ends[k], True
        return min(best, self.nots[i]) if i < len(self.nots) else best


class First:
    """The first of a list's values that is above another, in steps that grow with the logarithm of the list."""

    def __init__(self, values: list[float]) -> None:
        n = 1
        while n < len(values):
            n *= 2
        self.n, self.most = n, [float("-inf")] * n + values + [float("-inf")] * (n - len(values))
        for i in range(n - 1, 0, -1):
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def above(self, x: float, i: int, j: int) -> int:
        """The smallest place from i on, before j, with a value above x; else j."""
        if i >= j:
            return j
        most, n, p = self.most, self.n, self.n + i
        while most[p] <= x:
            while p & 1:
                p >>= 1
            if not p:
                return j
            p += 1
        while p < n:
            p *= 2
            if most[p] <= x:
                p += 1
        return min(p - n, j)


class OldCleans:
    """The CLEANs of old pages, and what becomes of pages in them.

    least: of a class, the CLEANs (seq, lru_seq, id) that left expired pages alive, which are those from this place in LRU
    order on; in all other CLEANs all expired pages of the class go. counts and late collect what decides on these places:
    how many pages that are not expired each class has (as differences), and which ones are the first time in a CLEAN's way.
    """

    def __init__(self, at: list[tuple[int, int]], least: dict[int, list[tuple[int, int, str]]]) -> None:
        at = sorted(at)
        self.seqs, self.ts = [seq for seq, _ in at], [ts for _, ts in at]
        self.back = any(a > b for a, b in zip(self.ts, self.ts[1:]))
        self.later, place = First(self.ts), {seq: i for i, seq in enumerate(self.seqs)}
        self.least: dict[int, tuple[list[float], First]] = {}
        self.names: dict[int, dict[int, str]] = {}
        for ua, rows in least.items():
            values: list[float] = [float("inf")] * len(at)
            for seq, lru_seq, _ in rows:
                values[place[seq]] = lru_seq
            self.least[ua], self.names[ua] = (values, First(values)), {place[seq]: name for seq, _, name in rows}
        self.counts: Counter[tuple[int, int]] = Counter()
        self.late: list[tuple] = []

    def count(self, ua: int, i: int, j: int) -> None:
        self.counts[ua, self.seqs[i]] += 1
        if j < len(self.seqs):
            self.counts[ua, self.seqs[j]] -= 1

    def takes(self, name: str, page: Page, i: int, j: int) -> bool:
        """Whether one of the CLEANs i to j takes a page that has no command among them."""
        e = self.later.above(page.expire, i, j)
        if i < e:
            self.count(page.ua, i, e)
        if e == j:
            return False
        self.late.append((name, page.ua, page.expire, page.lru_seq, self.seqs[e], self.seqs[j] if j < len(self.seqs) else -NEVER))
        gone = e
        if page.ua in self.least:
            values, first = self.least[page.ua]
            while (gone := first.above(page.lru_seq - 1, gone, j)) < j:
                # an equal lru_seq: the id decides
                if self.ts[gone] > page.expire and (values[gone] > page.lru_seq or self.names[page.ua][gone] > name):
                    break
                gone += 1
        if self.back:  # where times go back, it may not be expired any more
            for i in range(e, gone):
                if self.ts[i] <= page.expire:
                    self.count(page.ua, i, i + 1)
        return gone < j


def _values(column: pa.Array) -> list:
    """A column's values; a null list is an empty one."""
    if pa.types.is_list(column.type):
        values, ends = _values(column.values), column.offsets.to_pylist()
        return [values[a:b] for a, b in zip(ends, ends[1:])]
    if column.null_count or pa.types.is_struct(column.type):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """MARKED rows as Arrow's."""
    columns = zip(*rows) if rows else [[]] * len(MARKS)
    return pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, TYPES)], names=MARKS)


def _packed(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """seqs: the sequence numbers of rows with the same keys, in order, a row for each stretch of a million numbers; more: likewise."""
    lists = rows.groupBy(*keys, F.shiftright("seq", 20).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("seq", *more))).alias("_l"))
    return lists.select(*keys, F.col("_l.seq").alias("seqs"), *(F.col(f"_l.{c}").alias(f"{c}s") for c in more))


def _fold(log: DataFrame, state: DataFrame | None, always: bool, old: DataFrame | None = None, least: DataFrame | None = None) -> DataFrame:
    """MARKED rows: pages, and counts and late ones of OldCleans. old: seq and ts of the CLEANs of old pages; least as there."""
    spark = log.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = F.col("op") == "CLEAN"
    zeros = {c: F.lit(0).cast("long") for c in ("seq", "ts", "lifetime", "usize")} | {"ua": F.lit(0)}
    lifetime = F.coalesce("lifetime", F.when(F.col("op") == "TOUCH", 0).otherwise(-1))
    single = log.where(~clean).select("id", "seq", "ts", "ua", "op", lifetime.alias("lifetime"), own(F.col("tags")).alias("tags"), F.coalesce("usize", F.lit(0)).cast("long").alias("usize"))
    if state is not None:
        known = state.select("id", F.struct(*(F.col(c) for c in NAMES)).alias("state")).withColumns(zeros | {"seq": F.lit(NEVER), "op": F.lit("STATE")})
        single = single.unionByName(known, allowMissingColumns=True)
    single = single.withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(parts)), "kind": F.lit(1)})
    # CLEANs go to every partition, before its pages, those with the same tags in one row
    modes = log.where(clean & F.col("mode").isin("all", "matchall", "matchany", "matchnot"))
    every = _packed(modes.withColumn("tags", F.array_sort(F.array_distinct(own(F.col("tags"))))), ["mode", "tags"])
    if old is not None:
        every = every.unionByName(_packed(old.withColumn("mode", F.lit("old")), ["mode"], "ts"), allowMissingColumns=True)
    if least is not None:
        every = every.unionByName(_packed(least.withColumn("mode", F.lit("least")), ["mode", "ua"], "lru_seq", "id"), allowMissingColumns=True)
    filled = {c: F.coalesce(c, v) if c in every.columns else v for c, v in zeros.items()}
    every = every.withColumns(filled | {"part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))), "kind": F.lit(0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = page = cleans = olds = None
        given: list[tuple] = []
        old_at: list[tuple[int, int]] = []
        least_at: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        taken, at = float("inf"), 0

        def upto(seq: float) -> None:
            """What CLEANs between the page's last command and seq do to it."""
            nonlocal at
            if olds:
                to = bisect_left(olds.seqs, seq, at)
                if page.alive and at < to:
                    till = bisect_left(olds.seqs, taken, at, to) if taken < seq else to
                    if olds.takes(name, page, at, till):
                        page.drop()
                at = to
            if taken < seq:
                page.drop()

        def marks() -> pa.RecordBatch:
            rows = [(None, ua, *[None] * 9, "count", seq, n, None) for (ua, seq), n in olds.counts.items() if n]
            rows += [(i, ua, None, None, expire, lru_seq, *[None] * 5, "late", seq, None, until) for i, ua, expire, lru_seq, seq, until in olds.late]
            olds.counts, olds.late = Counter(), []
            return _batch(rows)

        for b in batches:
            done: list[tuple] = []
            columns = [_values(b.column(c)) if c in b.schema.names else repeat(None) for c in ROWS]
            for kind, i, seq, ts, ua, op, lifetime, tags, usize, mode, seqs, tss, lru_seqs, ids, known in zip(*columns):
                if page is not None and (kind == 0 or i != name):
                    upto(float("inf"))
                    done.append((*page.row(name), "page", None, None, None))
                    page = None
                if kind == 0:
                    if cleans is not None:  # a task may have several partitions: the CLEANs are the same
                        continue
                    if mode == "old":
                        old_at += zip(seqs, tss)
                    elif mode == "least":
                        least_at[ua] += zip(seqs, lru_seqs, ids)
                    else:
                        given.append((mode, tuple(tags), seqs))
                    continue
                if cleans is None:
                    cleans, olds = Cleans(given), OldCleans(old_at, least_at) if old_at else None
                if page is None:
                    name, page, taken, at = i, Page(), float("inf"), 0
                if op == "STATE":
                    page.tags, page.alive = list(known["tags"]), bool(known["alive"])
                    for c in ("ua", "mtime", "expire", "lru_seq", "usize", "loads", "hits", "errors"):
                        setattr(page, c, int(known[c]))
                    if page.alive:
                        taken = cleans.first(page.tags, NEVER)
                    continue
                upto(seq)
                page.apply(int(seq), int(ts), int(ua), op, int(lifetime), tags, int(usize), always)
                if not page.alive:
                    taken = float("inf")
                elif op == "SAVE":
                    taken = cleans.first(page.tags, int(seq))
            yield _batch(done)
        if page is not None:
            upto(float("inf"))
            yield _batch([(*page.row(name), "page", None, None, None)])
        if olds:
            yield marks()

    both = single.unionByName(every, allowMissingColumns=True).repartition(parts, "part").sortWithinPartitions("part", "kind", "id", "seq")
    return both.mapInArrow(run, MARKED)


def fold(log: DataFrame, state: DataFrame | None = None, always: bool = True) -> DataFrame:
    """STATE of each page after the last command of log, from an earlier STATE on; log has no CLEAN of mode old."""
    return _fold(log, state, always).select(*NAMES)


def _least(marked: DataFrame, old: DataFrame, retain: tuple[int, ...]) -> DataFrame:
    """least of OldCleans (ua, seq, lru_seq, id) by the counts and late pages of a fold.

    A class keeps expired pages in a CLEAN only while fewer than retain others are left: so many as are missing, the last
    ones in LRU order. They stay in its way until a command, or a CLEAN of another kind, ends that (until). So of the late
    ones of a CLEAN no more than retain matter, and each class's CLEANs are followed with so many pages in memory.
    """
    each = Window.partitionBy("ua").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    grid = old.withColumn("ua", F.explode(F.array(*map(F.lit, range(len(retain))))))
    changed = marked.where("mark = 'count'").groupBy("ua", "seq").agg(F.sum("n").alias("n"))
    left = grid.join(changed, ["ua", "seq"], "left").withColumn("_n", F.coalesce(F.sum("n").over(each), F.lit(0)))
    room = left.select("ua", "seq", "ts", F.greatest(by_ua(F.col("ua"), retain) - F.col("_n"), F.lit(0)).alias("room"))
    newest = Window.partitionBy("ua", "seq").orderBy(F.desc("lru_seq"), F.desc("id"))
    late = marked.where("mark = 'late'").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= max(retain))
    late = late.join(room, ["ua", "seq"]).where("_k <= room").select("ua", "seq", "ts", "room", "id", "expire", "lru_seq", "until", F.lit(0).alias("kind"))
    rows = room.withColumn("kind", F.lit(1)).unionByName(late, allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, kept = None, []
        for b in batches:
            done = []
            for ua, seq, ts, room, kind, name, expire, lru_seq, until in zip(*(b[c] for c in ("ua", "seq", "ts", "room", "kind", "id", "expire", "lru_seq", "until"))):
                if ua != of:
                    of, kept = ua, []
                if kind == 0:
                    kept.append((lru_seq, name, expire, until))
                    continue
                kept = [x for x in kept if x[3] > seq]
                if room == 0:
                    kept = [x for x in kept if x[2] >= ts]
                    continue
                may = sorted((x for x in kept if x[2] < ts), reverse=True)[:room]
                kept = may + [x for x in kept if x[2] >= ts]
                done.append((ua, seq, *(may[-1][:2] if len(may) == room else (NEVER, ""))))
            yield pd.DataFrame(done, columns=["ua", "seq", "lru_seq", "id"])

    filled = rows.fillna(0, ["expire", "lru_seq", "until"]).repartition("ua").sortWithinPartitions("ua", "seq", "kind")
    return filled.mapInPandas(run, "ua int, seq long, lru_seq long, id string")


def known(records: DataFrame) -> DataFrame:
    """Page records (id, ua, tags, mtime, expire, usize, lru_seq), as restored or derived, as STATE rows."""
    zero = F.lit(0).cast("long")
    filled = records.withColumns({"loads": zero, "hits": zero, "errors": zero, "alive": F.lit(True), "tags": own(F.col("tags"))})
    return filled.select(*NAMES)


def states(log: DataFrame, saved, state: DataFrame | None = None, retain: tuple[int, ...] = L.FPC_RETAIN, always: bool = True) -> DataFrame:
    """fold() of a log that may hold CLEANs of mode old: of each class the oldest expired pages go, as long as more than retain are left.

    saved writes a DataFrame to the shared folder and reads it back. The first fold lets all expired pages go; from what it
    counts follows which of them stay, the next fold goes by that, and so on until nothing changes. A CLEAN depends only on
    those before it, so each round settles one more at least, and in logs whose classes seldom run short all of them soon.
    """
    old = log.where("op = 'CLEAN' and mode = 'old'").groupBy("seq").agg(F.max("ts").alias("ts"))
    if old.isEmpty():
        return fold(log, state, always)
    least = None
    while True:
        marked = saved(_fold(log, state, always, old, least))
        found = saved(_least(marked, old, retain))
        if found.isEmpty() if least is None else found.exceptAll(least).isEmpty() and least.exceptAll(found).isEmpty():
            return marked.where("mark = 'page'").select(*NAMES)
        least = found
