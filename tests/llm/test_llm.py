"""Each operator against brute force, an exact round trip, SQL or held-out rows, and its defined cases."""

import array
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tagfold.llm import license_templates, near_dedup, packing, permutation_index, quality_forest, range_coder, rule_ensemble, source_mix, text_stats, token_counts, tokens, warc

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "a b", "a  b", " lead", "tail ", "x\ny", "x \ny", "é ñ ß", "漢字 text", "<|endoftext|> x", "don't we'll", "A" * 3000, "w " * 5000, "1 22 333"]


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null doc_id and a null source."""
    rows = [(i, t, "en", f"src{i % 3}", 0) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id here", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- tokens ---

PARTS = [*"aBs'té É\n\t1½_.<|>", "<|endoftext|>", "<|ENDOFTEXT|>", "ab.", "Éa,", "\u0301", "\u00a0", "\u0130", "\x1c", "\u6f22", "  "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=6))
def test_pieces_give_the_librarys_ids(texts):
    for path in (BYTE, WORD):
        e = tokens.encoder(path)
        assert e.encode(texts) == e.whole(texts)


def test_cache_forgets():
    made = []
    g = tokens.Generations(3, lambda k: made.append(k) or k * 2)
    assert [g[k] for k in (1, 2, 3, 1, 4, 1, 5, 6, 7, 8, 1)] == [2, 4, 6, 2, 8, 2, 10, 12, 14, 16, 2]
    assert len(g) <= 3 and made.count(1) <= 2


# --- 1 ---
def expected_ids(rows, path, end):
    t = Tokenizer.from_file(path)
    return [[*t.encode(x or "", add_special_tokens=False).ids, *end] for x in rows]


def test_blocks_are_read_alone():
    r = np.random.default_rng(9)
    ids = np.minimum(r.zipf(1.2, 5_000), 30_000).astype("<u4")
    data = range_coder.segment([ids[:2000].tobytes(), ids[2000:].tobytes()])
    head = range_coder.header_of(data)
    for i in range(5):
        only = bytearray(len(data))  # nothing but the header and this block
        only[: head.starts[0]] = data[: head.starts[0]]
        only[head.starts[i] : head.starts[i + 1]] = data[head.starts[i] : head.starts[i + 1]]
        assert range_coder.read_block(bytes(only), i).tolist() == ids[1024 * i : 1024 * (i + 1)].tolist()
        with pytest.raises(ValueError, match="damaged"):
            range_coder.read_block(bytes(only), (i + 1) % 5)
    for at in (1, 20, head.starts[0] - 3):
        with pytest.raises(ValueError):
            range_coder.documents_of(data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :])


def test_models_learn(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").orderBy("doc_id").collect()]
    ids = np.frombuffer(b"".join(tokens.encoder(WORD).encode(texts)), "<u4")
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * len(range_coder.segment([ids.tobytes()])) / len(ids) < 0.9 * -(p * np.log2(p)).sum(), "more than order 0 could"


def test_segments_round_trip():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 60_000, 3000), np.zeros(1024), np.tile(rng.integers(0, 9, 7), 900), np.minimum(rng.zipf(1.3, 5000), 2**32 - 1), [7]):
        given_ = [np.array(ids).astype("<u4").tobytes(), b"", np.arange(5, dtype="<u4").tobytes()]
        data = range_coder.segment(given_)
        assert range_coder.documents_of(data) == given_
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises(Exception):
            assert range_coder.documents_of(bytes(broken)) == given_, "damage unnoticed"
    assert range_coder.documents_of(range_coder.segment([])) == []


def test_repetition_is_predicted():
    ids = np.tile(np.arange(40_000, 40_030), 200).astype("<u4")
    assert len(range_coder.segment([ids.tobytes()])) < len(ids) / 2


def test_coded_files_give_ids_back(spark, sf, odd, empty, monkeypatch):
    monkeypatch.setattr(range_coder, "SEGMENT", 5_000)
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet").repartition(3)):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        ids = expected_ids([r.text for r in rows], WORD, [1])
        starts = np.cumsum([0, *map(len, ids)]).tolist()
        want = [(r.doc_id, s, len(x), zlib.crc32(array.array("I", x).tobytes())) for r, s, x in zip(rows, starts, ids)]
        got = [tuple(r) for r in range_coder.read(range_coder.written(df, WORD)).orderBy("start").collect()]
        assert got == want
    assert range_coder.read(range_coder.written(empty, WORD)).count() == 0


def test_columns_ask_once_for_a_word():
    texts = ["", " ", "stone Stone, STONE. stone! ÉTÉ été?", "stone\nStone;  x1 it's\tco-op 'stone' a.b stone.. İstone été\u0301", "<|endoftext|> stone<|startoftext|>, ß ẞ ƻ ǅ,", "stone"] * 2
    enc, asked = tokens.Encoder(WORD), []
    word = enc.words.make
    enc.words.make = lambda w: asked.append(w) or word(w)
    looked = []
    piece = enc._piece
    enc.pieces.make = lambda p: looked.append(p) or piece(p)
    got = enc.encode_column(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == expected_ids(texts, WORD, [])
    assert asked.count("stone") == 1 and asked.count("été") == 1 and not {"stone", "Stone,", "STONE.", "été?"} & set(looked)
    assert enc.encode_column(pa.array([], pa.string())) == [] and enc.encode_column(pa.array(["", " \n"])) == [b"", b""]


def test_coder_carries_and_rare_ids():
    r = np.random.default_rng(5)
    for v, n in ((2, 30_000), (3_000, 40_000), (60_000, 70_000)):
        places = np.where(r.random(n) < 0.9, r.integers(0, 2, n), r.integers(0, v, n)).astype(np.int32)
        model = range_coder.fitted(places, v)
        assert np.array_equal(range_coder.decode(range_coder.encode(places, model), model, n), places)
        a = r.random((130, 7))
        assert np.allclose(range_coder.products(a, a[:7].T), a @ a[:7].T)


# --- 2 ---
def test_phrases_and_templates(spark, odd, empty):
    texts = ["CC BY cc-by, CC  by-sa. All rights reserved", "Released under the MIT License.", "Released under the MIT Licence", "This work is licensed under the GNU General Public License, version 3.", "all rights  Reserved all RIGHTS reserved", license_templates.MARKUP.sub(" ", license_templates.TEMPLATES["ISC"])]
    got = {r["doc_id"]: r for r in license_templates.scanned(docs_of(spark, texts)).collect()}
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [j for p in license_templates.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert [got[i]["labels"] for i in range(6)] == ["cc-by,reserved", "MIT-notice", "", "GPL-3.0-notice,gpl", "reserved", "ISC"]
    assert got[1]["score"] == 1 and got[2]["score"] == 0
    assert license_templates.scanned(odd).count() == len(ODD) + 2 and license_templates.scanned(empty).count() == 0


def as_pattern(template):
    """The same wording as a regular expression over words with a blank behind each."""
    out, at = [], 0
    for m in [*license_templates.MARKUP.finditer(template), None]:
        out += [re.escape(w.decode()) + " " for w in license_templates.words_of(template[at : m.start() if m else len(template)])]
        if m:
            at = m.end()
            out.append({"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or f"(?:[^ ]+ ){{0,{re.search('max=([0-9]+)', m[2])[1]}}}")
    return re.compile("(?:^|(?<= ))" + "".join(out))


def test_labels_and_scores_as_brute_force(spark, table):
    r = random.Random(5)
    texts = [x.text for x in table.collect()]
    for name, t in license_templates.TEMPLATES.items():
        for _ in range(8):  # regions filled, left out or too long, a mandatory word lost, between other words
            keep = r.random() < 0.5
            filled = re.sub(r"<<beginOptional>>(.*?)<<endOptional>>", lambda m: m[1] if keep else " ", t, flags=re.S)
            filled = re.sub(r"<<var[^>]*>>", lambda m: " " + " ".join(r.choice("pqr") for _ in range(r.randint(0, 4))) + " ", filled)
            w = filled.split()
            if r.random() < 0.3:
                w.pop(r.randrange(len(w)))
            texts.append(" ".join(["lead"] * r.randint(0, 3) + w + ["tail"] * r.randint(0, 3)))
    got = {x.doc_id: x for x in license_templates.scanned(docs_of(spark, texts)).collect()}
    patterns = {name: as_pattern(t) for name, t in license_templates.TEMPLATES.items()}
    for i, text in enumerate(texts):
        w = [x.decode() for x in license_templates.words_of(text or "")]
        joined = "".join(x + " " for x in w)
        phrases = {label for p, label in license_templates.PHRASES.items() if f" {p} " in f" {joined}"}
        assert got[i].base_labels == ",".join(sorted(phrases))
        found = {name for name, p in patterns.items() if p.search(joined)}
        assert got[i].labels == ",".join(sorted(phrases | found)), text
        assert (got[i].score > 0) == bool(phrases | found) and got[i].score <= 1
    one = license_templates.scanned(docs_of(spark, ["x alpha beta gamma delta y", "alpha beta gamma", "alpha beta z"]), {"t": "alpha beta<<beginOptional>>gamma delta<<endOptional>>"})
    assert {x.doc_id: x.score for x in one.collect()} == pytest.approx({0: 4 / 6, 1: 2 / 3, 2: 2 / 3})


def test_automaton_regions():
    a = license_templates.compiled("one <<beginOptional>>two <<var;name=x;max=2>> three<<endOptional>> four")
    accepts = lambda t: a.accepts(t.encode().split(), 0)
    assert [accepts(t) for t in ("one four", "one two three four", "one two x y three four z", "one two x y z three four", "one three four")] == [2, 4, 6, None, None]
    with pytest.raises(ValueError):
        license_templates.compiled("<<beginOptional>>only<<endOptional>>")


# --- 3 ---
def test_counts_and_cache(spark, odd, empty, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    t = Tokenizer.from_file(BYTE)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in odd.collect())
    run = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(df, BYTE, cache).collect())
    assert run(odd) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({r.text or "" for r in odd.collect()})
    assert run(odd) == want and spark.read.parquet(cache).count() == stored, "hits are not encoded again"
    assert run(empty) == []


# --- 4 ---
def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(w)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if n and 100 * n >= 75 * (len(a) + len(b) - n):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(a), root(i)) for i, a in sets}


def near_texts(seed, groups=6, copies=14):
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    for _ in range(groups):
        base = [word() for _ in range(r.choice([8, 60, 200]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = word()
            out.append(" ".join(t[: len(t) - r.randint(0, len(t) // 8)]))
    shared = " ".join(word() for _ in range(120))
    return out + [" ".join(word() for _ in range(90)) + " " + shared for _ in range(25)] + ["one two", "One  TWO", "one two three"]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_brute_force(spark, seed):
    texts = near_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.grouped(docs_of(spark, texts)).collect()}
    want = brute_components(list(enumerate(texts)))
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_components_cases(spark, odd, empty):
    rows = near_dedup.grouped(odd).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r.component_id == r.doc_id and r.kept for r in rows if r.doc_id is not None and r.n_shingles == 0)
    assert [r.kept for r in rows if r.doc_id is None] == [False] and [r.kept for r in rows if r.doc_id == 5] == [True, True]
    assert near_dedup.grouped(empty).count() == 0
    kept = near_dedup.filtered(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.doc_id for r in rows if r.kept})


def test_rows_without_or_with_repeated_doc_id(spark):
    r = random.Random(3)
    a, b, c, d, e = (" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)) for _ in range(5))
    df = spark.createDataFrame([(None, a), (None, a + " x"), (None, b), (7, c), (7, d), (8, d + " x"), (None, e), (9, e)], "doc_id long, text string")
    kept = near_dedup.filtered(df, unnamed=True).collect()
    assert len(kept) == 5 and {x.doc_id for x in kept if x.text in (a, a + " x", b)} == {None}
    assert sorted((x.doc_id, x.text) for x in kept if x.doc_id) == sorted([(7, c), (7, d), (9, e)])
    rows = near_dedup.grouped(df).collect()
    assert len(rows) == 8 and {x.doc_id: x.component_id for x in rows if x.doc_id in (8, 9)} == {8: 7, 9: 9}


def test_densified_signatures_estimate():
    rng = np.random.default_rng(1)
    for n in (3, 20, 400, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: int(n * 0.9)], rng.integers(0, 2**64, n - int(n * 0.9), dtype=np.uint64)])
        same_bins = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(same_bins - true) < (0.5 if n < 30 else 0.15)


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in near_dedup.components(edges).collect()} == {0}


def test_components_of_any_shape(spark):
    r = random.Random(8)
    ids = r.sample(range(10**6), 2600)
    chain, star, tree = ids[:2000], ids[2000:2200], ids[2200:]
    edges = [*zip(chain, chain[1:]), *((max(star), x) for x in star if x != max(star)), *((x, tree[r.randrange(i)]) for i, x in enumerate(tree) if i), (5, 5)]
    got = {x.node: x.component for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(part) for part in (chain, star, tree) for x in part}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_of_documents_in_any_order(spark):
    # each document is near the ones before and after it only
    r = random.Random(4)
    words_ = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(8 * 400 + 60)]
    texts = [" ".join(words_[8 * i : 8 * i + 60]) for i in range(400)]
    ids = r.sample(range(10**5), len(texts))
    got = near_dedup.grouped(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    want = brute_components(list(zip(ids, texts)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want and len({c for _, c in want.values()}) == 1


def test_links_beyond_the_first_candidates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BEST", 0)  # all by full sets
    texts = near_texts(7)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.grouped(docs_of(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


# --- 5 ---
def naive_counts(text):
    w, t = words(text), text or ""
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {k for k, n in collections.Counter(windows).items() if n > 1}
    inside = {i + j for i, x in enumerate(windows) if x in many for j in range(3)}
    lines = t.split("\n")
    dup = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab é\n\t#|漢 　"))), st.lists(st.sampled_from(["a", "b", "a b c", "\n", "x"]), max_size=30).map(" ".join)))
def test_counts_as_defined(text):
    assert text_stats.count(text)[:5] == naive_counts(text)


def test_rules_find_bad_rows(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    # calibrated on one half of the labels, measured on the other
    half = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2))
    for i in (0, 1):
        got = quality_forest.judge(docs, labels.where(half == i)).join(labels.where(half != i), "doc_id").where("not base_failed").toPandas()
        assert got[got.quality == 1].kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.1


def naive_path(forest, t, row):
    at = 0
    while forest.feature[t, at] >= 0:
        at = forest.left[t, at] + (row[forest.feature[t, at]] > forest.value[t, at])
    return forest.length[t, at]


def test_verdicts_as_brute_force(spark, table, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in table.collect()}
    counted = quality_forest.saved(text_stats.with_counts(table, ["doc_id"]), "t")
    model = quality_forest.fit_model(counted, labels)
    assert model.cuts
    for r in quality_forest.judge(table, labels).collect():
        c = np.array([text_stats.count(rows[r.doc_id])])
        n, chars, symbols, dup, again = naive_counts(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        base, odd = n < 50 or 100 * again > 50 * n, False
        for rule, cut in model.cuts.items():
            f, x = model.forests[rule], text_stats.features(c)[0][quality_forest.of(rule)]
            mean = sum(naive_path(f, t, x) for t in range(len(f.length))) / len(f.length)
            odd |= round(4096 * 2 ** -(mean / f.norm)) >= cut
        assert (r.base_failed, r.kept) == (base, not base and not odd)


def test_forest_judges_inside_the_range_of_good_texts(spark):
    # good texts have no digits or very many, bad ones some: no range test can tell them apart
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    digits = [0] * 240 + [60] * 80 + [30] * 12
    texts = [" ".join(str(r.randrange(10_000, 99_999)) if k < d else word() for k in range(100)) for d in digits]
    labels = spark.createDataFrame([(i, int(d != 30), 0) for i, d in enumerate(digits) if i % 2], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality_forest.judge(docs_of(spark, texts), labels).collect()}
    assert sum(not got[i] for i, d in enumerate(digits) if d == 30) >= 10
    assert sum(got[i] for i, d in enumerate(digits) if d != 30) >= 316


def test_thresholds_from_histograms():
    score, good, bad = np.array([10, 40, 20, 30]), np.array([500, 0, 1, 0]), np.array([3, 2, 0, 1])
    assert quality_forest.threshold(score, good, bad, 501) == (25, 3)
    assert quality_forest.threshold(score, good, bad, 400) == (25, 3) and quality_forest.threshold(score, good, bad * 0, 501)[1] == 0


def test_isolation_puts_strays_first():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (5, 3))]
    s = quality_forest.scores(quality_forest.fit(x), x)
    assert set(np.argsort(-s)[:5]) == set(range(500, 505))


def test_rules_cases(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        rows = quality_forest.judge(odd, labels).collect()
        assert len(rows) == len(ODD) + 2 and all(r.base_failed for r in rows if r.n_words < 50)
        assert quality_forest.judge(empty, labels).count() == 0
    clash = odd.selectExpr("*", "1 as kept", "2 as n_words", "3 as anomaly")
    assert quality_forest.filtered(clash, one).columns == clash.columns


# --- 6 ---
def test_recall_and_cases(spark, sf):
    t = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/embeddings.parquet")
    want = {(r[0], r[2]) for r in connect(sf.replace("sf0.001", "sf0.01")).sql(permutation_index.BRUTE_FORCE_SQL).fetchall()}
    got = permutation_index.search(t, F.col("vec_id") % 100 == 0).collect()
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want) and len(got) == len(want)
    bad = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [3.0, 0.0]), (None, [1.0, 1.0])]
    rows = permutation_index.search(spark.createDataFrame(bad, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in rows] == [(1, 1, 0.0), (2, 2, 0.0), (3, 9, 2.0)]
    assert permutation_index.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_recall_with_other_pivots_and_repeated_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)).astype("float32")
    x[:1000] = x[0]  # one vector holds a third of all rows
    df = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    for seed in (1, 2):
        got = collections.defaultdict(list)
        for r in permutation_index.search(df, F.col("vec_id") % 100 == 0, seed=seed, pivots=400).collect():
            got[r.query_id].append((r.rank, r.vec_id, r.score))
        hits = 0
        for q in range(0, 3000, 100):
            d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
            d[q] = np.inf
            want = np.lexsort((np.arange(3000), d))[:10]
            assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
            assert all(s == pytest.approx(d[v]) for _, v, s in got[q])
            hits += len({v for _, v, _ in got[q]} & set(want.tolist()))
        assert hits >= 0.9 * 300


def test_footrule_from_postings(spark):
    rng = np.random.default_rng(2)
    order = np.array([rng.permutation(30)[:8] for _ in range(40)])
    place = lambda o: np.array([list(o).index(p) if p in o else 8 for p in range(30)])
    want = [[int(np.abs(place(q) - place(o)).sum()) for o in order] for q in order[:5]]
    assert permutation_index.footrules(order[:5], order, 30).tolist() == want
    files = permutation_index.Postings(order, 30)
    for q, far in zip(order, want):
        assert files.within(q, 50).tolist() == [i for i, d in enumerate(far) if d <= 50]
    x, pivots = rng.normal(size=(50, 4)), rng.normal(size=(20, 4))
    pivots[7] = pivots[3]
    assert permutation_index.orders(x, pivots, 6).tolist() == np.argsort(((x[:, None] - pivots) ** 2).sum(2).round(9), 1, kind="stable")[:, :6].tolist()


# --- 7 ---
def test_archives_and_transactions(spark):
    page = [(1, "http://a/1", "x\r\n\r\nWARC/1.1\r\n"), (2, "http://a/2", "x\r\n\r\nWARC/1.1\r\n"), (3, None, None), (4, "http://a/4\r\n", ""), (5, "u", "é" * 20000), (5, "u", "é" * 20000), (None, "n", "é" * 20000)]
    path = warc.write(spark.createDataFrame(page, "page_id long, url string, html string"))
    found = warc.read(spark, path)
    assert found.count() == 3 * len(page)
    t = warc.transactions(found).collect()
    assert len(t) == len(page) and all(r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id == r.capture_id for r in t)
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.captures(spark, path).collect())
    assert got == [(0, 40000, "revisit", 5), (1, 15, "response", None), (2, 15, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 40000, "response", None), (5, 40000, "response", None)]
    import base64

    digests = {r.page_id: r.payload_digest for r in warc.captures(spark, path).collect()}
    assert digests[5] == base64.b32encode(hashlib.sha1(("é" * 20000).encode()).digest()).decode()
    assert warc.captures(spark, warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    ids = lambda x: sorted((r.warc_type, r.record_id, r.refers_to) for r in x.collect())
    again = warc.write(spark.createDataFrame(page[::-1], "page_id long, url string, html string").repartition(3))
    assert ids(found) == ids(warc.read(spark, again)), "reruns write the same records"
    named = {r.record_id: r for r in found.collect()}
    assert all(named[r.refers_to].warc_type == "response" for r in named.values() if r.warc_type == "revisit") and len(named) == 3 * len(page)


def test_each_record_is_a_member_of_its_own(spark, tmp_path):
    import gzip

    page = spark.createDataFrame([(1, "u", "a" * 3_000_000, 0), (2, "v", "b", 1)], "page_id long, url string, html string, digest int")
    path = warc.write(page, str(tmp_path / "w"))
    data = b"".join(open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    starts = [m.start() for m in re.finditer(re.escape(gzip.compress(b"", mtime=0)), data)]
    assert data.count(b"\x1f\x8b\x08") == 12 and len(starts) == 6
    assert sorted(gzip.decompress(data[a:b])[:8] for a, b in zip([0, *(s + 20 for s in starts)], starts)) == [b"WARC/1.1"] * 6
    assert sorted(r.payload_bytes for r in warc.captures(spark, path).collect()) == [1, 3_000_000]
    whole = b"".join(warc.plain(data))
    assert whole == gzip.decompress(data)
    for broken in (data[: len(data) // 2], data[:300] + bytes([data[300] ^ 1]) + data[301:]):
        with pytest.raises((ValueError, zlib.error)):
            [warc._row(h, x, False) for h, x in warc.parse(warc.plain(broken))]


def test_hot_groups_join_as_others(spark, monkeypatch):
    from tagfold.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "h" if i % 3 == 1 else f"k{i}") for i in range(60)], "i long, k string")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    got = common.joined_to_groups(rows, groups.where("k is null or k != 'k2'"), ["k"], "n", F.col("i")).collect()
    assert sorted((r.i, r.k, r.least) for r in got) == sorted((i, None, 0) if i % 3 == 0 else (i, "h", 1) if i % 3 == 1 else (i, f"k{i}", i) for i in range(60) if i != 2)


# --- 8 ---
def test_mix_cases(spark, odd, empty, table):
    sized = odd.select("doc_id", "source", source_mix.size_of(F.col("text")).alias("size"))
    rows = source_mix.mix(sized, ["doc_id"]).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert source_mix.mixed(empty).count() == 0
    clash = table.withColumnRenamed("lang", "size").withColumn("_start", F.lit(1)).withColumn("target", F.lit(2))
    mixed = source_mix.mixed(clash)
    assert mixed.columns == clash.columns
    total = sum(len(words(r.text)) for r in mixed.collect())
    plan = source_mix.mix(table.select("doc_id", "source", source_mix.size_of(F.col("text")).alias("size")), ["doc_id"]).collect()
    assert total == sum(r.taken for r in plan) and abs(total - 1.5 * sum(r["size"] for r in plan)) <= 20


def test_targets_as_resharing(spark):
    for sizes in ([10, 1000, 30, 5, 0], [7], [100, 100], [1, 1, 10**6]):
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in source_mix.targets(df).orderBy("source").collect()]
        w, cap, left, full = [(3, 1, 2)[i % 3] for i in range(len(sizes))], [2 * n for n in sizes], 1.5 * sum(sizes), {}
        while True:
            open_ = [i for i in range(len(sizes)) if i not in full]
            share = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
            over = [i for i in open_ if share[i] > cap[i]]
            if not over:
                break
            for i in over:
                full[i] = cap[i]
                left -= cap[i]
        assert got == pytest.approx([full.get(i, share.get(i)) for i in range(len(sizes))])


def test_mix_follows_the_points(spark, monkeypatch):
    # two sources of equal words, weights 3 and 1, blocks of 64 words: slots as the golden points say
    docs = spark.createDataFrame([(i, "w " * 40, "en", f"s{i % 2}", 80) for i in range(400)], DOCS)
    sized = docs.select("doc_id", "source", source_mix.size_of(F.col("text")).alias("size"))
    rows = source_mix.mix(sized, ["doc_id", "source"]).collect()
    words_ = {r.source: round(r.target) for r in rows}
    total, share = sum(words_.values()), words_["s0"] / sum(words_.values())
    slots = [(k + 1) * 2_654_435_769 % 2**32 / 2**32 < share for k in range(-(-total // 64) + 1)]
    of = {"s0": [k for k, x in enumerate(slots) if x], "s1": [k for k, x in enumerate(slots) if not x]}
    for name in of:  # the streams' first blocks are in the source's first slots, in order
        first = sorted((r.first_slot for r in rows if r.source == name and r.taken))
        assert first[0] == of[name][0] and set(first) <= set(of[name]) | set(range(len(slots), len(slots) + 5))
    # the written mix interleaves: any run of it has the sources' shares
    names = [r.source for r in source_mix.mixed(docs).collect()]
    for at in range(0, len(names) - 100, 50):
        assert abs(names[at : at + 100].count("s0") / 100 - share) < 0.12


def test_golden_points_are_even(spark):
    u = np.array([r[0] for r in spark.range(1, 4097).select(source_mix.golden(F.col("id"))).collect()])
    assert len(set(u)) == 4096 and max(abs(np.sort(u) - np.arange(4096) / 4096)) < 0.002
    assert u[:3] == pytest.approx([(k * 2_654_435_769 % 2**32) / 2**32 for k in (1, 2, 3)])


# --- 9 ---
@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=20))
def test_plans_hold_every_piece(counts):
    plan = packing.plan(counts, 50)
    got = collections.Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 50 and n > 0
        for s in lengths:
            got[s] += n
    assert got == counts
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 50))


def test_completion_beats_best_fit():
    counts = {44: 1, 24: 1, 22: 3, 21: 1, 17: 1, 8: 1, 6: 2}  # two best-fit choices waste a sequence here
    assert sum(n for _, n in packing.plan(counts, 61)) <= 4


def test_completion_branches_beside_whole_pieces():
    counts = {25: 2, 3: 2, 37: 2, 63: 1, 42: 3, 53: 1, 61: 1, 24: 1, 32: 1, 41: 4, 4: 1, 100: 2}
    assert sum(n for _, n in packing.best_fit(counts, 100)) == 10
    assert sum(n for _, n in packing.plan(counts, 100)) == 9  # the lower bound


def fewest(pieces, capacity):
    """Sequences of the best packing, by trying every open sequence for each piece."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def go(i, rooms):
        if len(rooms) < best[0]:
            if i == len(pieces):
                best[0] = len(rooms)
                return
            for room in {x for x in rooms if x >= pieces[i]}:
                j = rooms.index(room)
                go(i + 1, [*rooms[:j], room - pieces[i], *rooms[j + 1 :]])
            go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best[0]


def test_plans_are_the_best_of_small_cases():
    r = random.Random(12)
    assert sum(n for _, n in packing.plan(collections.Counter([12, 14, 16, 18, 22, 23, 25, 25, 25, 27, 27]), 61)) == 4
    for _ in range(300):
        capacity = r.choice([20, 61, 100])
        pieces = [r.randint(capacity // 9, int(capacity * r.choice([0.5, 0.7, 1]))) for _ in range(r.randint(1, 16))]
        assert sum(n for _, n in packing.plan(collections.Counter(pieces), capacity)) == fewest(pieces, capacity)


def test_dominance():
    spare = lambda *x: sum(1 << s for s in x)
    assert packing.dominated((3, 2), 1, spare(5)) and packing.dominated((3, 2), 1, spare(6)) and packing.dominated((3, 2), 1, spare(4))
    assert not packing.dominated((3, 2), 1, spare(7)) and not packing.dominated((5,), 1, spare(5)) and not packing.dominated((3, 2), 0, spare(3, 4))


def test_packing_of_documents(spark, odd, empty, table):
    for df in (odd, table):
        ids = collections.defaultdict(list)
        for r in df.collect():
            ids[r.doc_id].append(expected_ids([r.text], BYTE, [2])[0])
        rows = packing.packed(df, BYTE).toPandas()
        total = sum(len(x) for many in ids.values() for x in many)
        assert rows.length.sum() == total and rows.length.max() <= 1024
        for r in rows.itertuples():
            part = ids[None if r.doc_id != r.doc_id else int(r.doc_id)][0][r.start : r.start + r.length]
            assert zlib.crc32(array.array("I", part).tobytes()) == r.ids_crc32 and (r.length == 1024 or r.piece == 0)
        for _, s in rows.sort_values("offset").groupby("sequence_id"):
            assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
        assert rows.sequence_id.nunique() <= -(-total // 1024) * 1.05 + 1
    assert packing.packed(empty, BYTE).count() == 0


def test_sequences_hold_ids(spark):
    df = docs_of(spark, ["hello world " * 30, "x", "some more words"])
    s = packing.sequences(packing.pack(packing.saved(packing.pieces(df, BYTE, with_ids=True), "t"))).collect()
    assert sum(r.n_ids for r in s) == sum(len(r["ids"]) // 4 for r in s) and all(r["ids"][-4:] == b"\2\0\0\0" for r in s)


# --- 10 ---
def test_classifier_on_held_out_rows(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    got = entry.queries()["op10_rule_ensemble"](spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))


def test_compiled_rules_score_like_numpy(spark, table):
    rng = np.random.default_rng(4)
    counted = text_stats.with_counts(table, ["doc_id"]).toPandas()
    x = text_stats.features(counted[list(text_stats.COUNTS)].to_numpy(np.int64))
    y = ((x[:, 4] > np.median(x[:, 4])) ^ (rng.random(len(x)) < 0.1)).astype(int)
    model = rule_ensemble.fit(x, y)
    assert model.rules
    want = dict(zip(counted.doc_id, rule_ensemble.predicted(model, x)))
    for r in rule_ensemble.scored(table, model, ["doc_id"]).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9)


def test_classifier_cases(spark, odd, empty):
    for rows in ([], [(1, 1, 0), (None, 0, 0), (2, None, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        model = rule_ensemble.train(odd, labels)
        got = rule_ensemble.scored(odd, model, ["doc_id"]).collect()
        assert len(got) == len(ODD) + 2 and all(0 < r.score < 1 for r in got)
        assert rule_ensemble.scored(empty, model, ["doc_id"]).count() == 0
    clash = odd.selectExpr("*", "1 as score", "2 as n_words")
    assert rule_ensemble.filtered(clash, labels).columns == clash.columns


# --- defined cases of all ---
LONG = "word " * 700_000  # 3.5 million characters


def test_clashing_columns_and_long_texts(spark):
    """Columns named like what operators add are left alone, and very long texts are taken whole."""
    extra = "1 as n_words, 2 as digest, 3 as score, 4 as size, 5 as row, 6 as signature, 7 as start, 8 as piece, 9 as length, 10 as kept, 11 as _text, 12 as node, 13 as content, 14 as rank, 15 as part, 16 as _quality, 17 as anomaly"
    docs = docs_of(spark, [LONG, "a b c d e f", None]).selectExpr("*", *(x.strip() for x in extra.split(",")))
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    by = lambda df, *c: {r.doc_id: tuple(r[x] for x in c) if len(c) > 1 else r[c[0]] for r in df.collect()}
    t = Tokenizer.from_file(WORD)
    n = [len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in (LONG, "a b c d e f", None)]
    assert by(range_coder.read(range_coder.written(docs, WORD)), "n_tokens") == dict(enumerate(n))
    assert by(license_templates.scanned(docs), "n_words") == {0: 700_000, 1: 6, 2: 0}
    counts = by(token_counts.count(docs, BYTE), "n_bytes", "over_limit")
    assert counts == {0: (3_500_000, True), 1: (11, False), 2: (0, False)}
    assert by(near_dedup.grouped(docs), "n_shingles") == {0: 1, 1: 2, 2: 0}
    judged = by(quality_forest.judge(docs, labels), "n_words", "n_repeat_words", "base_failed")
    assert judged == {0: (700_000, 700_000, True), 1: (6, 0, True), 2: (0, 0, True)}
    model = rule_ensemble.train(docs, labels)
    assert all(0 <= x <= 1 for x in by(rule_ensemble.scored(docs, model, ["doc_id"]), "score").values())
    pieces = packing.packed(docs, BYTE)
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id = 0").first().n == len(Tokenizer.from_file(BYTE).encode(LONG, add_special_tokens=False).ids) + 1
    mixed = source_mix.mixed(docs)
    assert mixed.columns == docs.columns and near_dedup.filtered(docs).columns == docs.columns


def test_pipeline_of_odd_rows(spark, tmp_path, sf):
    """Nulls, repeated rows, extra columns and an empty table from end to end."""
    import corpus_pipeline

    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    rows = [*((i, t, "en", f"s{i % 2}", 1) for i, t in enumerate(ODD)), *((100 + i, t, "en", None if i % 3 else "s0", 1) for i, t in enumerate(good)), (None, good[3] + " x y z", None, None, None), (101, good[1], "en", "s0", 1)]
    for name, given_ in (("rows", rows), ("empty", [])):
        d = tmp_path / name
        spark.createDataFrame(given_, DOCS).selectExpr("*", "1 as score", "2 as _slot").write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(100 + i, i % 2, 0) for i in range(10)] if given_ else [], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(d)).toPandas()
        assert out.columns.tolist() == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (len(out) > 0) == bool(given_)
        if given_:
            assert set(out.doc_id.dropna()) <= {r[0] for r in rows} and out.groupby("sequence_id").length.sum().max() <= 1024


# --- all ---
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if re.match(r"op\d+_", n)))
def test_agrees_with_sql(spark, sf, name):
    same(spark, name, sf)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.saved(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == names or i == len(corpus_pipeline.STAGES) - 1
        ids, had = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        assert ids <= set(had)
        if name == "near_duplicates":
            want = brute_components(list(had.items()))
            assert ids == {i for i, (_, c) in want.items() if c == i}
        if name == "mix_sources":
            plan = {r.doc_id: r for r in source_mix.mix(before.select("doc_id", "source", source_mix.size_of(F.col("text")).alias("size")), ["doc_id"]).collect()}
            got = collections.Counter()
            for r in docs.select("doc_id", "text").collect():
                got[r.doc_id] += len(words(r.text))
                assert words(had[r.doc_id])[: len(words(r.text))] == words(r.text)
            assert dict(got) == {i: r.taken for i, r in plan.items() if r.taken}
        if name == "pack_sequences":
            t = Tokenizer.from_file(BYTE)
            total = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect())
            assert docs.agg(F.sum("length")).first()[0] == total and ids == set(had)
    assert sorted(corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length").collect()) == sorted(docs.select("doc_id", "piece", "length").collect())


def test_nothing_else_needs_this_package():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "tagfold")):
        for f in files:
            if f.endswith(".py") and "llm" not in folder:
                assert "tagfold.llm" not in open(os.path.join(folder, f)).read(), f
