import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from tessera.llm import packing  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@given(st.text(st.sampled_from(list("ab Z9.,'\n\t  \u0085é中s<|end of text|>")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(IDS(text), "<u4").tolist() == WANT(text)


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "a", " ", "  b", "\n", "é"]), max_size=8).map("".join))
@settings(max_examples=200, deadline=None)
def test_added_tokens_have_their_id(text):
    assert np.frombuffer(IDS(text), "<u4").tolist() == WANT(text)


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=12), st.lists(st.integers(0, 11), max_size=12))
@settings(max_examples=200, deadline=None)
def test_sums_of_lengths_left(counts, taken):
    have = np.zeros(41, np.int64)
    for length, n in counts.items():
        have[length] = n
    sums, lengths = packing.Sums(have), sorted(counts)
    for k in taken:
        length = lengths[k % len(lengths)]
        if sums.left[length]:
            sums.take({length: 1}, 1)
    here = (sums.left > 0).astype(np.int64)
    assert sums.pairs.tolist() == np.convolve(here, here)[:41].tolist()
    assert sums.triples.tolist() == np.convolve(np.convolve(here, here)[:41], here)[:41].tolist()


IDS, WANT = packing.id_encoder(PATH), reference()


def check(made, cap):
    places = defaultdict(list)
    for r in made:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cap
    return len(places)


def test_pieces_of_odd_rows(docs, odd):
    made = packing.pack(docs(odd), PATH).collect()
    check(made, packing.CAP)
    want = []
    for k, text in odd:
        ids = [*WANT(text or ""), 2]
        at, size, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            own = ids[at : at + size]
            want.append((k, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
            at, size, piece = at + len(own), 1024, piece + 1
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made) == sorted(want)


def test_empty_and_null_id(docs):
    assert packing.pack(docs([]), PATH).count() == 0
    assert packing.pack(docs([(None, None)]), PATH).first()["length"] == 1


def test_clashing_columns(docs, odd):
    from pyspark.sql import functions as F

    clash = docs(odd).withColumns({c: F.lit(7) for c in ("piece", "start", "length", "_salt", "_n", "_at", "_before", "_within", "sequence_id")})
    assert packing.pack(clash, PATH).count() == packing.pack(docs(odd), PATH).count()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_plan_places_all(counts):
    plan, n = packing.plan_sequences(counts, 64)
    total = defaultdict(int)
    filled = defaultdict(list)
    begins = {(x, first): None for x, first, *_ in plan}
    assert len(begins) == len(plan)
    for x in counts:
        own = sorted(r for r in plan if r[0] == x)
        for r, following in zip(own, [*own[1:], (x, counts[x])]):
            for i in range(following[1] - r[1]):
                filled[r[3] + i // r[2]].append((r[4] + i % r[2] * x, x))
            total[x] += following[1] - r[1]
    assert dict(total) == counts and len(filled) == n
    for own in filled.values():
        at = 0
        for offset, x in sorted(own):
            assert offset == at
            at += x
        assert at <= 64


def test_few_sequences():
    rng = random.Random(1)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(1024, 1 + int(rng.lognormvariate(5.5, 1)))] += 1
    _, n = packing.plan_sequences(counts)
    bound = -(-sum(k * v for k, v in counts.items()) // 1024)
    assert n <= bound * 1.001 + 1


def test_exact_complements_come_first():
    plan, n = packing.plan_sequences({600: 5, 424: 2, 300: 2, 124: 2, 200: 1, 100: 1}, 1024)
    assert n == 5
