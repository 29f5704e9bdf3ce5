"""Expected answers of the cache's own test scripts, and properties of the folds."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagfold.functions import lifetimes as L
from tagfold.functions import scalars
from tagfold.operators import codecs, commands, eviction, sessions, stats, tags, urls
from tagfold.sources import snapshots
from tagfold.streaming import sessions as live

NOW = 1_706_745_600


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("fpc-1", ["tag-1", "tag-2"]), ("fpc-2", ["tag-2", "tag-3"]), ("fpc-3", ["tag-3", "tag-4"])]
    return spark.createDataFrame(rows, "id string, tags array<string>").withColumn("expire", F.lit(NOW + 5))


def names(df):
    return sorted(r["id"] for r in df.collect())


def test_matching(pages):
    assert names(tags.matching(pages, ["tag-2"])) == ["fpc-1", "fpc-2"]
    assert names(tags.matching(pages, ["tag-2", "tag-3", "tag-2"])) == ["fpc-2"]
    assert names(tags.matching(pages, ["non-existent-tag"])) == names(tags.matching(pages, ["tag-1", "tag-4"])) == names(tags.matching(pages, [])) == []
    assert names(tags.not_matching(pages, ["tag-4"])) == ["fpc-1", "fpc-2"]
    assert names(tags.not_matching(pages, ["tag-3", "tag-4"])) == ["fpc-1"]
    assert names(tags.not_matching(pages, [])) == names(tags.matching_any(pages, ["tag-2", "tag-3"])) == ["fpc-1", "fpc-2", "fpc-3"]
    assert names(tags.matching_any(pages, [])) == []


def test_clean_sequence(pages):
    left = pages
    for mode, given, want in (("matchall", ["tag-1", "tag-2"], ["fpc-2", "fpc-3"]), ("matchnot", ["tag-2", "tag-3"], ["fpc-2", "fpc-3"]), ("matchany", ["tag-1", "tag-2"], ["fpc-3"]), ("old", [], ["fpc-3"]), ("all", [], [])):
        keep = tags.survivors(left, mode, given, NOW)
        assert names(keep) == want
        left = left.join(keep, "id")


def test_untagged_are_found_by_the_reserved_tag(spark):
    df = spark.createDataFrame([("fpc-4", []), ("fpc-5", ["tag-5"])], "id string, tags array<string>")
    assert names(tags.untagged(df)) == names(tags.matching(df, [tags.UNTAGGED])) == ["fpc-4"]
    assert [r["tag"] for r in tags.tags(df).collect()] == ["tag-5"]


def test_durations_and_sizes(spark):
    given = ["30s", "5", "2H", "0x10m", "010", "1w", "x", "", "7y"]
    df = spark.createDataFrame([(x,) for x in given], "v string").select(scalars.parse_duration(F.col("v")).alias("d"), scalars.parse_size(F.col("v")).alias("s"))
    assert [r["d"] for r in df.collect()] == [30, 5, 7200, 960, 8, 604800, None, None, None]
    shown = spark.createDataFrame([(0,), (59,), (60,), (5400,), (86_400 * 14,), (1 << 20,)], "n long").select(scalars.print_duration(F.col("n")).alias("d"), scalars.print_size(F.col("n")).alias("s"))
    assert [(r["d"], r["s"]) for r in shown.collect()] == [("0s", "0b"), ("59s", "59b"), ("1m", "60b"), ("90m", "5400b"), ("2w", "1209600b"), ("1048576s", "1m")]


def test_masks_escape(spark):
    named = spark.createDataFrame([("a_b",), ("axb",), ("a%b",), ("A_B_c",)], "name string")
    masks = spark.createDataFrame([("a_b*",), ("*" * 200,)], "mask string").withColumn("pattern", scalars.mask_pattern(F.col("mask")))
    assert sorted(r["name"] for r in stats.wildcard(named, masks).collect()) == ["A_B_c", "a_b"]


def naive(log):
    out = {}
    for seq, ts, name, ua, op, lifetime in log:
        out.setdefault(name, sessions.Session()).apply(seq, ts, ua, op, lifetime)
    return out


def random_log(n, seed):
    r, ts, out = random.Random(seed), NOW, []
    for seq in range(n):
        ts += r.choice([0, 0, 1, 20, 40, 4000])
        op = r.choice(["READ", "READ", "WRITE", "WRITE", "DESTROY"] if r.random() < 0.3 else ["READ", "WRITE"])
        out.append((seq, ts, f"s{r.randint(0, 5)}", r.randint(0, 3), op, r.choice([-1, 0, 30, 5000]) if op == "WRITE" else None))
    return out


def test_fold_over_many_batches(spark):
    log = random_log(3000, 5)
    df = spark.createDataFrame(random.Random(1).sample(log, len(log)), "seq long, ts long, id string, ua int, op string, lifetime long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    got = {r["id"]: tuple(r)[1:] for r in sessions.fold(df).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: s.row(k)[1:] for k, s in naive(log).items()}


def test_stream_equals_batch(spark, tmp_path):
    log = random_log(600, 9)
    schema = "seq long, ts long, id string, ua int, op string, lifetime long"
    for i in range(3):
        spark.createDataFrame(log[i * 200 : (i + 1) * 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = live.drain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    # files are taken in the order of their times, which is that of seq
    assert {r["id"]: r["num_writes"] for r in got.collect()} == {k: s.num_writes for k, s in naive(log).items()}


def test_eviction_follows_a_walk(spark):
    r = random.Random(3)
    rows = [(f"r{i}", r.randint(0, 3), r.randint(0, 200_000), r.randint(1, 100)) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, ua int, lru_seq long, usize long")
    retain, total = (1, 2, 50, 100), sum(x[3] for x in rows)
    left, want, used = [sum(x[1] == u for x in rows) for u in range(4)], set(), total
    for name, ua, _, size in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        if used <= total - 5000:
            break
        if left[ua] > retain[ua]:
            left[ua] -= 1
            used -= size
            want.add(name)
    assert set(names(eviction.evicted(df, F.lit(5000), retain))) == want


def test_authentication(spark):
    df = spark.createDataFrame([(a, p) for a in ("info", "user", "admin") for p in ("none", "user", "admin", "bulk")], "auth string, provided string")
    ok = lambda **k: [(r["auth"], r["provided"]) for r in df.where(commands.authenticated(F.col("auth"), F.col("provided"), **k)).collect()]
    assert ok() == [("info", p) for p in ("none", "user", "admin", "bulk")] + [("user", "user"), ("user", "admin"), ("user", "bulk"), ("admin", "admin")]
    assert ok(info_auth="admin", user_set=False) == [("info", "admin"), *(("user", p) for p in ("none", "user", "admin", "bulk")), ("admin", "admin")]


def test_codecs(spark):
    df = spark.createDataFrame([("a", "x" * 5000), ("b", "short"), ("c", "")], "id string, payload string")
    best = codecs.best(df).collect()
    assert [r["id"] for r in best] == ["a"] and best[0]["codec"] != "snappy" and best[0]["size"] < 5000
    sizes = spark.createDataFrame([("a" * 80,), ("é" * 9,), ("",), ("aB1",), ("A" * 32,)], "t string").select(codecs.hesper_size(F.col("t")))
    assert [r[0] for r in sizes.collect()] == [57, None, None, None, 22]


def test_url_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# urls\n\n0.75 http://a/x\n0.50  https://b/y\nnonsense\n")
    (tmp_path / "map.xml").write_text("<urlset><url>\n<loc>http://a/x</loc><priority>0.5</priority><lastmod>2024-01-02T00:00:00+00:00</lastmod></url><url><loc>http://c</loc></url></urlset>")
    assert [tuple(r) for r in snapshots.url_list(spark, str(tmp_path / "list.txt")).collect()] == [("http://a/x", 750), ("https://b/y", 500)]
    assert [tuple(r) for r in snapshots.site_map(spark, str(tmp_path / "map.xml")).collect()] == [("http://a/x", 500, 1_704_153_600)]


def test_url_page(spark):
    u = spark.createDataFrame([(f"u{i}", i % 3 * 100, i, i) for i in range(10)], "url string, priority_milli long, lastmod long, ord long")
    assert [r["url"] for r in urls.page(u, 100, 200, 1, 1, 3).collect()] == ["u5", "u8", "u1"]
    assert urls.page(u, 0, 200, 0, 0, 0).count() == 10


def test_range_of_nothing(spark):
    assert stats.value_range(spark.range(0), F.col("id")).first()["shown"] == "(none)"


def test_lifetimes(spark):
    df = spark.createDataFrame(pd.DataFrame({"ua": [0, 3, 1, 2], "lifetime": [-1, 0, 10**9, 60]}))
    got = [r[0] for r in df.select(L.fpc_expire(F.lit(100).cast("long"), F.col("lifetime"), F.col("ua").cast("int"))).collect()]
    assert got == [86_500, L.INFINITE, 2_592_100, 160]


def test_scripts(spark, tmp_path):
    from tagfold.sources import scripts

    (tmp_path / "s.cfg").write_text("# comment\n\nsave 'a b' \"it's\" 'q\\'s' tag\n  getids\n")
    assert [(r["op"], r["args"]) for r in scripts.commands(spark, str(tmp_path / "s.cfg")).orderBy("at").collect()] == [("SAVE", ["a b", "it's", "q's", "tag"]), ("GETIDS", [])]
    (tmp_path / "inner.cfg").write_text("save x '\\41\\n' @payload.txt\n")
    (tmp_path / "outer.cfg").write_text(f"ping\nexecute {tmp_path}/inner.cfg\ngettags\n")
    payloads = spark.createDataFrame([("payload.txt", "whole text")], "file string, text string")
    got = scripts.commands(spark, str(tmp_path / "outer.cfg"), payloads).orderBy("at").collect()
    assert [(r["op"], r["args"]) for r in got] == [("PING", []), ("SAVE", ["x", "A\n", "whole text"]), ("GETTAGS", [])]
    (tmp_path / "loop.cfg").write_text(f"execute {tmp_path}/loop.cfg\n")
    with pytest.raises(ValueError, match="deep"):
        scripts.commands(spark, str(tmp_path / "loop.cfg"))


def test_stream_counts_late_files(spark, sf, tmp_path):
    from tagfold.sources.tables import session_log_of

    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").toPandas()
    n = len(events)
    for i in (9, 2, 7, 0, 5, 8, 1, 6, 3, 4):  # a file later than those with newer days
        spark.createDataFrame(events[i * n // 10 : (i + 1) * n // 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = session_log_of(live.events(spark, str(tmp_path)))
    want = session_log_of(spark.read.parquet(str(tmp_path / "events.parquet"))).groupBy(F.expr("ts div 86400 * 86400").alias("day"), "op").agg(F.count("*").alias("num"))
    got = live.counted(stream)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.agg(F.sum("num")).first()[0] == n


def test_fold_refuses_unknown_commands():
    with pytest.raises(ValueError, match="GC"):
        sessions.Session().apply(1, NOW, 3, "GC", None)


def page_commands(spark, rows):
    """rows: (ts, op, id, ua, lifetime, tags, usize, mode) in order."""
    full = [(i, ts, name, ua, op, lifetime, tags_, size, mode) for i, (ts, op, name, ua, lifetime, tags_, size, mode) in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, ts long, id string, ua int, op string, lifetime long, tags array<string>, usize long, mode string")


def alive(df):
    return names(df.where("alive"))


def test_page_fold_follows_the_server_script(spark):
    from tagfold.operators import pages as P

    t = ["first", "binlog-tag-two"]
    start = [(NOW, "SAVE", "binlog-record", 3, -1, ["binlog-tag-one", "binlog-tag-two"], 17, None), (NOW, "SAVE", "another-record", 3, -1, ["binlog-tag-two", "binlog-tag-three"], 18, None)]
    steps = [*start, (NOW + 1, "SAVE", "test", 3, -1, t, 24, None), (NOW + 2, "LOAD", "test", 3, None, None, None, None), (NOW + 3, "TOUCH", "test", 0, 7 * 86_400, None, None, None)]
    state = P.fold(page_commands(spark, steps))
    assert names(tags.matching(state, ["binlog-tag-two", "binlog-tag-three"])) == ["another-record"]
    assert names(tags.not_matching(state, ["binlog-tag-three"])) == ["binlog-record", "test"]
    assert names(tags.matching_any(state, ["first", "binlog-tag-two", "binlog-tag-three"])) == ["another-record", "binlog-record", "test"]
    row = state.where("id = 'test'").first()
    assert (row.expire, row.mtime, row.usize, row.loads, row.hits) == (NOW + 3 + L.FPC_MAX[3], NOW + 1, 24, 1, 1)
    gone = [*steps, (NOW + 4, "REMOVE", "test", 0, None, None, None, None), (NOW + 5, "TEST", "test", 3, None, None, None, None), (NOW + 6, "TOUCH", "test", 0, 604_800, None, None, None), (NOW + 7, "LOAD", "test", 3, None, None, None, None)]
    row = P.fold(page_commands(spark, gone)).where("id = 'test'").first()
    assert (row.alive, row.loads, row.hits, row.errors) == (False, 3, 1, 1)
    again = [*gone, (NOW + 8, "SAVE", "test", 1, 60, ["b", "a", "b"], 6510, None)]
    row = P.fold(page_commands(spark, again)).where("id = 'test'").first()
    assert (row.alive, row.usize, row.ua, row.expire, row.tags) == (True, 6510, 1, NOW + 68, ["b", "a"])


def test_page_fold_cleans(spark):
    from tagfold.operators import pages as P

    steps = [(NOW, "SAVE", f"fpc-{i}", 3, 3600 if i == 1 else 0, [f"tag-{i}", None, f"tag-{i + 1}"], 9, None) for i in (1, 2, 3)] + [(NOW, "SAVE", "bare", 3, 0, None, 0, None)]
    clean = lambda mode, *given: (NOW, "CLEAN", None, None, None, list(given), None, mode)
    for more, want in (
        ([], ["bare", "fpc-1", "fpc-2", "fpc-3"]), ([clean("matchall", "tag-1", "tag-2")], ["bare", "fpc-2", "fpc-3"]), ([clean("matchnot", "tag-2", "tag-3")], ["fpc-1", "fpc-2", "fpc-3"]),
        ([clean("matchany", "tag-1", "tag-2")], ["bare", "fpc-3"]), ([clean("matchall", tags.UNTAGGED)], ["fpc-1", "fpc-2", "fpc-3"]), ([clean("matchall")], ["bare", "fpc-1", "fpc-2", "fpc-3"]), ([clean("all")], []),
        ([clean("all"), steps[1]], ["fpc-2"]),
    ):
        assert alive(P.fold(page_commands(spark, [*steps, *more]))) == want


def test_page_states_clean_old_pages(spark, tmp_path):
    from tagfold.operators import pages as P

    r, rows, ts = random.Random(6), [], NOW
    for i in range(400):
        ts += r.choice([1, 400, 3000])
        op = r.choice(["SAVE"] * 6 + ["LOAD", "TOUCH", "REMOVE", "CLEAN"])
        tags_ = [r.choice("xyz")]
        rows.append((ts, op, None if op == "CLEAN" else f"p{r.randint(0, 60)}", r.randint(0, 1), r.choice([0, 60, 5000]) if op == "SAVE" else 30, tags_, 1, r.choice(["old", "old", "matchall"]) if op == "CLEAN" else None))
    retain = (3, 2, 2, 2)
    got = P.states(page_commands(spark, rows), snapshots.saved(spark, "t"), retain=retain, always=False)
    pages_ = {}
    for seq, (ts, op, name, ua, lifetime, tags_, size, mode) in enumerate(rows):
        if op != "CLEAN":
            pages_.setdefault(name, P.Page()).apply(seq, ts, ua, op, lifetime, tags_, size, False)
        elif mode != "old":
            [p.clean(mode, set(tags_)) for p in pages_.values() if p.alive]
        else:
            for u in range(4):
                chain = sorted((p.lru_seq, k) for k, p in pages_.items() if p.alive and p.ua == u)
                left = len(chain)
                for _, k in chain:
                    if left > retain[u] and pages_[k].expire < ts:
                        pages_[k].drop()
                        left -= 1
    assert {x.id: tuple(x)[1:] for x in got.collect()} == {k: p.row(k)[1:] for k, p in pages_.items()}
    # the same in three parts, from state to state
    state = None
    for a in (0, 130, 260):
        part = page_commands(spark, rows).where(f"seq >= {a} and seq < {a + 130 if a < 260 else 400}")
        state = snapshots.saved(spark, "t")(P.states(part, snapshots.saved(spark, "t"), state, retain=retain, always=False))
    assert {x.id: tuple(x)[1:] for x in state.collect()} == {k: p.row(k)[1:] for k, p in pages_.items()}


def test_old_pages_are_cleaned_in_a_few_rounds(spark):
    from tagfold.operators import pages as P

    r, rows = random.Random(11), []
    for i in range(1500):
        # times go back twice
        ts = NOW + i % 600 * 300 + r.randint(0, 50)
        op = r.choice(["SAVE"] * 6 + ["LOAD", "LOAD", "TOUCH", "REMOVE", "CLEAN"])
        clean = op == "CLEAN"
        rows.append((ts, op, None if clean else f"p{r.randint(0, 90)}", r.randint(0, 3), r.choice([0, 60, 5000, 90_000]) if op == "SAVE" else 30, [r.choice("xyz")], 1, r.choice(["old"] * 6 + ["matchall", "matchnot"]) if clean else None))
    retain, pages_, writes = (3, 2, 10, 20), {}, []

    def counted(df):
        writes.append(1)
        return snapshots.saved(spark, "t")(df)

    got = P.states(page_commands(spark, rows), counted, retain=retain)
    for seq, (ts, op, name, ua, lifetime, tags_, size, mode) in enumerate(rows):
        if op != "CLEAN":
            pages_.setdefault(name, P.Page()).apply(seq, ts, ua, op, lifetime, tags_, size, True)
        elif mode != "old":
            [p.clean(mode, set(tags_)) for p in pages_.values() if p.alive]
        else:
            for u in range(4):
                chain = sorted((p.lru_seq, k) for k, p in pages_.items() if p.alive and p.ua == u)
                left = len(chain)
                for _, k in chain:
                    if left > retain[u] and pages_[k].expire < ts:
                        pages_[k].drop()
                        left -= 1
    assert {x.id: tuple(x)[1:] for x in got.collect()} == {k: p.row(k)[1:] for k, p in pages_.items()}
    assert sum(x[1] == "CLEAN" and x[7] == "old" for x in rows) > 60
    assert len(writes) < 60, "before: two for each of these CLEANs"


def test_a_page_meets_its_clean_without_the_others():
    from tagfold.operators import pages as P

    r = random.Random(8)
    draw = lambda most: tuple(r.sample("abcdef", r.randint(0, most)))
    cleans = [(r.choice(["matchall", "matchany", "matchnot", "matchnot"] + ["all"] * (seq % 50 == 0)), draw(3) + (("a",) if seq < 200 else ()), [seq]) for seq in range(0, 600, 2)]
    found = P.Cleans(cleans)
    for _ in range(500):
        tags_, since = list(draw(4)), r.randint(-5, 610)
        hit = []
        for mode, given, (seq,) in cleans:
            page = P.Page()
            page.apply(0, NOW, 3, "SAVE", -1, tags_, 1, True)
            page.clean(mode, set(given))
            hit += [seq] if seq >= since and not page.alive else []
        assert found.first(tags_, since) == min(hit, default=float("inf"))
    # 20,000 saves among 40,000 CLEANs that all spare the page: in the time of a few steps each
    spared = P.Cleans([("matchnot", ("a", "b"), list(range(0, 40_000, 2))), ("matchnot", ("a",), list(range(1, 40_000, 2))), ("matchany", ("c",), list(range(40_000)))])
    begun = time.monotonic()
    assert {spared.first(["a"], i) for i in range(20_000)} == {float("inf")}
    assert time.monotonic() - begun < 20


def test_binlog_stops_at_the_first_bad_command(spark, tmp_path):
    log = page_commands(spark, [(NOW, "SAVE", "a", 1, -1, [], 1, None), (NOW, "LOAD", "a", 1, None, None, None, None), (NOW, "CLEAN", None, None, None, ["x"], None, "matchany"), (NOW, "TOUCH", "a", 9, 1, None, None, None), (NOW, "REMOVE", "a", 1, None, None, None, None)])
    path = snapshots.binlog(log, str(tmp_path / "b"))
    got = snapshots.replayed(spark, path)
    assert sorted(r.op for r in got.collect()) == ["CLEAN", "SAVE"]
    assert snapshots.replicated(got, "from_network").count() == 0, "what comes from a binlog isn't written to one"
    snapshots.binlog(log.where("seq = 0"), path)
    assert spark.read.parquet(f"{path}/commands").count() == 5
    for header in ('{"signature": "tagfold binlog", "version": 7}', '{"signature": "other", "version": 1}', ""):
        (tmp_path / "c" / "header").mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / "header" / "h.json").write_text(header)
        with pytest.raises(ValueError):
            snapshots.replayed(spark, str(tmp_path / "c"))


def test_null_tags_are_none(spark):
    df = spark.createDataFrame([("a", ["x", None], NOW), ("b", None, None), ("c", [None], NOW - 9), ("d", ["y"], NOW - 9)], "id string, tags array<string>, expire long")
    assert names(tags.not_matching(df, ["y"])) == ["a", "b", "c"] and names(tags.matching_any(df, ["x", "y"])) == ["a", "d"]
    assert names(tags.untagged(df)) == names(tags.matching(df, [tags.UNTAGGED])) == ["b", "c"]
    assert names(tags.survivors(df, "matchany", ["y"], NOW)) == ["a", "b", "c"] and names(tags.survivors(df, "matchnot", ["y"], NOW)) == ["d"]
    assert names(tags.survivors(df, "old", [], NOW)) == ["a", "b"]
    assert {r.tag: r.num for r in tags.tag_counts(df).collect()} == {"x": 1, "y": 1, tags.UNTAGGED: 2}
    assert sorted(r.tag for r in tags.tags(df).collect()) == ["x", "y"]


def test_null_payloads_and_round_trips(spark):
    df = spark.createDataFrame([("a", None), ("b", "y" * 3000)], "id string, payload string")
    assert [r["id"] for r in codecs.best(df, codecs=codecs.KNOWN).collect()] == ["b"]
    for codec in codecs.KNOWN:
        packed = codecs.recoded(df, codec)
        assert packed.where("id = 'b'").first().payload != b"y" * 3000
        assert sorted((r.id, bytes(r.payload)) for r in codecs.recoded(packed, codec, back=True).collect()) == [("a", b""), ("b", b"y" * 3000)]


def test_resource_names_anywhere_in_a_url(spark):
    urls_ = ["http://a/x.css", "http://js.example/x", "http://a/page", "http://a/X.CSS", "http://a/icons/"]
    df = spark.createDataFrame([(u,) for u in urls_], "u string")
    blocked = lambda **k: [r.b for r in df.select(scalars.blocked(F.col("u"), **k).alias("b")).collect()]
    assert blocked(css=False, js=False, images=True) == [True, True, False, False, False]
    assert blocked(css=True, js=True, images=False) == [False, False, False, False, True] and blocked(css=True, js=True, images=True) == [False] * 5


def test_lru_modes_lengthen_every_read():
    s = sessions.Session()
    for always in (False, True):
        s.drop()
        s.apply(1, NOW, 3, "WRITE", -1)
        s.apply(2, NOW + 10, 3, "READ", None, always=always)
        assert s.expire == (NOW + 10 + L.SESSION_READ_EXTRA[3] if always else NOW + L.SESSION_FIRST[3])


def test_locks_of_requests(spark):
    rows = [(1, 0, "a", "READ", 1), (2, 1, "a", "READ", 2), (3, 2, "a", "READ", 1), (4, 3, "a", "WRITE", 1), (5, 4, "a", "READ", 3), (6, 20, "a", "READ", 4), (7, 22, "a", "READ", 5), (8, 23, "a", "DESTROY", 9), (9, 23, "b", "READ", 1)]
    log = spark.createDataFrame(rows, "seq long, ts long, id string, op string, request_id long")
    # 2 waits for 1 till its write; 3 is the holder's own but finds 2's; 5 finds 2's lock within 8 s, which nothing releases in time
    assert sorted(map(tuple, sessions.lock_waits(log).collect())) == [("a", 1, 2, 2, False), ("a", 2, 3, 8, True), ("a", 2, 5, 8, True), ("a", 6, 7, 1, False)]


def test_stream_drops_what_it_has_seen(spark, tmp_path):
    schema = "seq long, ts long, id string, ua int, op string, lifetime long"
    log = random_log(300, 4)
    for part in (log[:200], log[100:300]):  # the second file repeats half of the first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = live.drain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    assert {r["id"]: (r["num_writes"], r["reads"]) for r in got.collect()} == {k: (s.num_writes, s.reads) for k, s in naive(log).items()}


def test_garbage_above_the_quota(spark):
    rows = [("a", 0, 1, 40, NOW + 9), ("b", 0, 2, 40, NOW + 9), ("c", 0, 3, 40, NOW - 9), ("d", 0, 4, 40, NOW + 9)]
    df = spark.createDataFrame(rows, "id string, ua int, lru_seq long, usize long, expire long")
    gone = lambda **k: names(eviction.collected(df, F.col("expire") < NOW, (1, 1, 1, 1), **k))
    assert gone() == ["c"] and gone(quota=130) == ["a", "c"] and gone(quota=130, mode="lru") == ["a"] and gone(quota=1, mode="strict-lru") == []


def test_client_verbs(spark, tmp_path):
    from tagfold.plans.client import Client, lifetime_of, tags_of

    assert [lifetime_of(x) for x in (3600, None, False, 0)] == [3600, 0, -1, 0] and [tags_of(x) for x in ("a", ["a", "b"], None)] == [["a"], ["a", "b"], []]
    c = Client(spark, NOW)
    c.save("fpc-1", 3600, ["tag-1", "tag-2"], "sample FPC record")
    c.save("fpc-2", None, ["tag-2", "tag-3"], "medium record")
    c.save("fpc-3", False, ["tag-3", "tag-4"], "large record")
    c.save("fpc-5", 3600, "tag-5", "FPC record with single tag")
    assert names(c.get_ids_matching_tags("tag-2")) == ["fpc-1", "fpc-2"] and names(c.get_ids_matching_tags(["tag-2", "tag-3"])) == ["fpc-2"]
    assert names(c.get_ids_not_matching_tags(["tag-4", "tag-5"])) == ["fpc-1", "fpc-2"] and names(c.get_ids_matching_any_tags(["tag-4", "tag-5"])) == ["fpc-3", "fpc-5"]
    assert {r.id: r.expire for r in c.page_state().collect()} == {"fpc-1": NOW + 3600, "fpc-2": L.INFINITE, "fpc-3": NOW + L.FPC_DEFAULT[3], "fpc-5": NOW + 3600}
    assert c.clean("matchall", ["tag-1", "tag-2"]) and not c.clean("some") and c.get_last_error() == "CLEAN: no mode some"
    assert names(c.get_ids()) == ["fpc-2", "fpc-3", "fpc-5"] and not c.load("") and c.get_metadatas("fpc-5").first().tag_list == "tag-5"
    assert c.test("fpc-1").count() == 0 and c.test("fpc-2").first().mtime == NOW
    c.write("session-1", False, "sample session record")
    c.read("session-1")
    c.write("session-2", None, "x")
    c.destroy("session-2")
    assert names(c.session_state()) == ["session-1"] and c.gc(60).count() == 0
    lines = sorted(r.line for r in c.info({"FPC": 1000, "": None}).collect())
    assert lines == ["Combined memory quota: not set", "FPC memory: 51 / 1000 bytes (used / quota)", "FPC store: 3 records", "Global memory: 51 bytes used", "Session memory: 0 / not set bytes (used / quota)", "Session store: 1 record"]
    (tmp_path / "c.cfg").write_text("# options\nmax_fpc_memory 2g # most\n\nmax_session_memory 512m\n")
    c.set("max_fpc_memory", "1g")
    c.remote_config(str(tmp_path / "c.cfg"))
    assert sorted(tuple(r) for r in c.get("max_*_memory").collect()) == [("max_fpc_memory", "2g"), ("max_session_memory", "512m")]
    path = c.store(str(tmp_path / "snap"))
    again = Client(spark, NOW + 10)
    again.restore(path)
    again.touch("fpc-5", 100)
    assert names(again.get_ids()) == ["fpc-2", "fpc-3", "fpc-5"] and again.page_state().where("id = 'fpc-5'").first().expire == NOW + 10 + 3600 + 100
    c.log("hello")
    assert c.logged().first().line == "2024.02.01 00:00:00 hello" and c.rotate("log_%d.txt").first().name == f"log_{NOW}.txt"
    assert c.stats("Cache_*", 4).count() == 2 and c.ping() and c.get_capabilities()["infinite_lifetime"]


def test_result_pages_and_work_caps(spark):
    df = spark.range(10)
    assert [r.id for r in stats.sliced(df, [F.col("id")], 3, 4).collect()] == [3, 4, 5, 6] and stats.sliced(df, [F.col("id")], 8, 0).count() == 2
    assert df.select(stats.sliced_text(F.lit("abcdef"), 2, 3).alias("t"), stats.sliced_text(F.lit("abcdef"), 4, 0).alias("u")).first()[:] == ("cde", "ef")
    assert [stats.work_cap(x) for x in (0, 1, 33, 34, 66, 67, 99, 100)] == [1_000_000_000, 1_000, 1_000, 500, 500, 200, 200, 100] and stats.work_cap(100, stats.RECOMPRESSIONS) == 0
