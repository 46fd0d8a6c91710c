import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components, simhash, suffixes, superkmers
from tessera.llm import superwindows as sw


def rows(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.collect())


OP5, OP9, OP10 = ("doc_id", "fingerprint", "component_id"), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), ("doc_id", "n_words", "n_removed", "kept_sha256")


def single(odd):
    """One row for a doc_id, as the plain versions need."""
    return list({k: (k, t) for k, t in odd}.values())


def test_suffixes_on_odd_rows(docs, odd):
    assert rows(suffixes.dedup(docs(single(odd))), *OP9) == brute.op9(single(odd))


def test_superkmers_on_odd_rows(docs, odd):
    assert rows(superkmers.dedup(docs(single(odd))), *OP10) == brute.op10(single(odd))


def test_repeated_rows_do_not_remove_themselves(docs):
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(80))
    assert {r["n_removed"] for r in suffixes.dedup(docs([(3, text), (3, text)])).collect()} == {0}
    assert {r["n_removed"] for r in superkmers.dedup(docs([(3, text), (3, text)])).collect()} == {0}
    got = rows(superkmers.dedup(docs([(3, text), (3, text), (4, text), (None, text)])), "n_words", "n_removed")
    assert got == [(80, 0), (80, 0), (80, 80), (80, 80)]


@pytest.mark.parametrize("most", [1, 4])
def test_hot_minimisers(docs, odd, monkeypatch, most):
    monkeypatch.setattr(sw, "HOT", most)
    rng = random.Random(5)
    passage = " ".join(str(rng.randrange(10**4)) for _ in range(90))
    own = single(odd) + [(k, f"{rng.random()} {passage[rng.randrange(9) :]} {rng.random()} the end of it {k}") for k in range(200, 230)]
    assert rows(suffixes.dedup(docs(own)), *OP9) == brute.op9(own)
    assert rows(superkmers.dedup(docs(own)), *OP10) == brute.op10(own)


@pytest.mark.parametrize("op, names, plain", [(suffixes, OP9, brute.op9), (superkmers, OP10, brute.op10)])
def test_edges_of_a_common_passage_are_not_cut_into_windows(docs, monkeypatch, op, names, plain):
    monkeypatch.setattr(sw, "HOT", 20)
    rng = random.Random(6)
    text = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage, cut, repeated = text(70), [], sw.repeated

    def counted(source, scan):
        cut.append(sw.places(source, scan).count())
        return repeated(source, scan)

    monkeypatch.setattr(sw, "repeated", counted)
    own = [(k, f"{text(40)} {passage} {text(40)}") for k in range(120)]
    assert rows(op.dedup(docs(own)), *names) == plain(own)
    assert len(cut) == 2 and cut[1] < len(own)


def test_colliding_keys(docs, odd, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sw, "text_hash", lambda body: F.pmod(F.xxhash64(body), F.lit(2)).cast("long"))
    assert rows(suffixes.dedup(docs(single(odd))), *OP9) == brute.op9(single(odd))
    assert rows(superkmers.dedup(docs(single(odd))), *OP10) == brute.op10(single(odd))


@pytest.mark.parametrize("hot", [3, sw.HOT])
def test_dedup_of_documents(docs, spark, data, monkeypatch, hot):
    monkeypatch.setattr(sw, "HOT", hot)
    own = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(suffixes.dedup(docs(own)), *OP9) == brute.op9(own)
    assert rows(superkmers.dedup(docs(own)), *OP10) == brute.op10(own)


@pytest.mark.parametrize("most", [1, 4 << 20])
def test_buckets_over_many_batches(spark, docs, monkeypatch, most):
    rng = random.Random(8)
    passage = " ".join(str(rng.randrange(10**4)) for _ in range(60))
    own = [(k, f"{rng.random()} {passage} {rng.random()}" + " la" * (k % 3 * 60)) for k in range(40)]
    monkeypatch.setattr(sw.earlier, "__defaults__", (most,))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows(suffixes.dedup(docs(own)), *OP9) == brute.op9(own)
        assert rows(superkmers.dedup(docs(own)), *OP10) == brute.op10(own)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("seed", range(3))
def test_dedup_of_small_alphabets(docs, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("ab") for _ in range(70)) for _ in range(3)]
    own = [(k, " ".join(rng.choice([*pool, "a b", "c " * 30]) for _ in range(rng.randrange(1, 5)))) for k in rng.sample(range(100), 25)]
    assert rows(suffixes.dedup(docs(own)), *OP9) == brute.op9(own)
    assert rows(superkmers.dedup(docs(own)), *OP10) == brute.op10(own)


def test_empty_and_clashing_columns(spark, docs):
    empty = docs([]).limit(0)
    assert suffixes.dedup(empty).count() == superkmers.dedup(empty).count() == simhash.near_duplicates(empty).count() == 0
    from pyspark.sql import functions as F

    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(80))
    clash = docs([(1, text), (2, text + " end")]).withColumns({c: F.lit(7) for c in ("key", "_key", "_gone", "_copied", "row", "c0", "runs", "removed", "gram", "fp", "start", "bucket", "component_id")})
    assert rows(superkmers.dedup(clash), "doc_id", "n_removed") == [(1, 0), (2, 80)]
    assert rows(superkmers.rewritten(clash), "doc_id", "text", "key", "n_chars") == [(1, text, 7, len(text)), (2, "end", 7, 3)]
    assert rows(suffixes.dedup(clash), "doc_id", "n_removed") == [(1, 0), (2, len(text))]
    assert simhash.one_of_each(clash, simhash.near_duplicates(clash)).columns == clash.columns


@given(st.lists(st.text("ab", min_size=8, max_size=20), min_size=1, max_size=12), st.sampled_from([0, 8]))
@settings(max_examples=150, deadline=None)
def test_deep_shallow_finds_the_first_equal(texts, shallow):
    length = 8
    bodies = [t.encode() for t in texts]
    base = np.cumsum([0] + [len(b) for b in bodies])[:-1]
    at = np.concatenate([b + np.arange(len(t) - length + 1) for b, t in zip(base, bodies)])
    strings = suffixes.Strings(bodies, length)
    got = suffixes.repeats(strings, np.zeros(len(at), np.int64), at, shallow)
    first = {}
    assert got.tolist() == [first.setdefault(strings.raw[p : p + length], i) for i, p in enumerate(at.tolist())]


@given(st.lists(st.binary(min_size=13, max_size=13), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_blind_tries_compare_to_the_last_byte(bodies):
    strings = suffixes.Strings(bodies + bodies, 13)
    at = np.arange(2 * len(bodies)) * 13
    got = suffixes.repeats(strings, np.zeros(len(at), np.int64), at, 0)
    first = {}
    assert got.tolist() == [first.setdefault(b, i) for i, b in enumerate(bodies + bodies)]


@given(st.integers(1, 40), st.integers(1, 20))
@settings(deadline=None)
def test_sliding_min(n, width):
    x = np.random.default_rng(n).integers(0, 50, n + width)
    assert sw.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]


def test_equal_windows_share_their_minimiser():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    found = []
    for lead in (5, 17):
        grams = np.concatenate((rng.integers(0, 1 << 62, lead).astype(np.uint64), shared, rng.integers(0, 1 << 62, 9).astype(np.uint64)))
        start, count, anchor, gram = sw.runs_of(grams, np.ones(len(grams), bool), 20)
        found.append({(s - lead, a - lead, int(g)) for s0, c, a, g in zip(start, count, anchor, gram) for s in range(s0, s0 + c) if 0 <= s - lead <= 40})
    assert found[0] == found[1] and len(found[0]) == 41


# SimHash


def test_simhash_on_odd_rows(docs, odd):
    made = simhash.near_duplicates(docs(single(odd)))
    from pyspark.sql import functions as F

    assert rows(made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), *OP5) == brute.op5(single(odd))


def test_codes_are_perfect():
    for code in (simhash.GOLAY, simhash.HAMMING):
        bits, errors = simhash._syndromes(code)
        assert len(bits) == code[0] and len(set(errors.tolist())) == 1 << code[2] and max(int(e).bit_count() for e in errors) == code[3]


def test_pairs_within_the_threshold_meet():
    rng = np.random.default_rng(2)
    for distance in (1, 2):
        for _ in range(40):
            a = np.uint64(rng.integers(0, 1 << 63))
            b = a ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, distance, replace=False)))
            own = [set(simhash.nearest_anchor(x ^ simhash.flips(1)).tolist()) for x in (a, b)]
            assert own[0] & own[1]
            assert max(int(np.uint64(c) ^ a).bit_count() for c in own[0]) <= 8


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(6)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({x for s in seeds for x in [s, *(s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6))]})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    made = simhash.links(simhash.at_anchors(spark.createDataFrame(signed, "fp long").repartition(3)))

    def groups(pairs):
        root = {v: v for (v,) in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in pairs:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        return {v: find(v) for (v,) in signed}

    near = [(a, b) for (a,) in signed for (b,) in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert groups(made.collect()) == groups(near)


def test_large_cells_are_joined_as_small_ones(monkeypatch):
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 1 << 9, 200).astype(np.uint64) * np.uint64(0x0101))
    small = simhash.cell_links(values, 2)
    monkeypatch.setattr(simhash, "LARGE_CELL", 0)
    large = simhash.cell_links(values, 2)
    groups = lambda links: len(values) - len(set(links[0].tolist()))
    assert groups(small) == groups(large)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 70), (100, 90), (5, 5)]
    got = {r[0]: r[1] for r in components.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {90: 70, 100: 70}
    assert components.stars(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_keeps_one_row(docs):
    text = " ".join(map(str, range(100)))
    own = docs([(5, text), (5, text), (9, text), (1, "something else entirely here"), (None, "apart from all others it is")])
    kept = simhash.one_of_each(own, simhash.near_duplicates(own))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 5]
