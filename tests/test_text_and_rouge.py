import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, rouge
from tessera.functions.text import clean_spacing, replace_newline_token


@pytest.mark.parametrize("text", ["", "a", "é", "a\nb", "\U0001f600", "a\U0001f600b"])
def test_empty_token_spaces_out(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(replace_newline_token(F.col("t"), "").alias("x")).first()[0]
    assert got == text.replace("", " ")


def test_token_is_literal(spark):
    df = spark.createDataFrame([("a<n>b.c",)], "t string")
    assert df.select(replace_newline_token(F.col("t"), "<n>")).first()[0] == "a b.c"
    assert df.select(replace_newline_token(F.col("t"), ".")).first()[0] == "a<n>b c"


def test_clean_spacing(spark):
    df = spark.createDataFrame([("I do n't know , he 's here .",)], "t string")
    assert df.select(clean_spacing(F.col("t"))).first()[0] == "I don't know, he's here."


@pytest.mark.parametrize(("n", "mask"), [(0, [0, 0, 0, 0]), (3, [1, 1, 1, 0]), (4, [1, 1, 1, 1]), (5, [1, 1, 1, 1])])
def test_pad(spark, n, mask):
    df = spark.createDataFrame([(list(range(5, 5 + n)),)], "ids array<int>")
    ids, m, cut, ended = df.select(arrays.pad(F.col("ids"), 4), arrays.padded_mask(F.col("ids"), 4), arrays.truncate(F.col("ids"), 4), arrays.truncate(F.col("ids"), 4, 1)).first()
    assert m == mask
    assert ids == (list(range(5, 5 + n)) + [0] * 4)[:4]
    assert cut == list(range(5, 5 + min(n, 4)))
    assert ended == [*range(5, 5 + min(n, 3)), 1]


CASES = [
    ("", "the cat", 0, 0, 0), ("the cat", "", 0, 0, 0), ("a b", "c d", 0, 0, 0), ("the cat sat", "the cat sat", 1, 1, 1),
    ("the the the", "the cat", 0.4, 0, 0.4), ("b a", "a b", 1, 0, 0.5), (None, "a", 0, 0, 0),
]


def test_rouge_cases(spark):
    pairs = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "row_idx long, prediction string, reference string")
    for k, name in enumerate(("rouge1", "rouge2", "rougeL")):
        got = {r[0]: r[1] for r in rouge.METRICS[name](pairs).select("row_idx", "score.fmeasure").collect()}
        assert got == pytest.approx({i: c[2 + k] for i, c in enumerate(CASES)}), name


def plain_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_lcs_against_plain():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(90))] for _ in range(2))
        assert rouge.lcs_length(a, b) == plain_lcs(a, b) == len(rouge.lcs_places(a, b))


def test_lsum_without_newlines_is_l(spark):
    rng = random.Random(4)
    rows = [(i, *(" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 30))) for _ in range(2))) for i in range(30)]
    pairs = spark.createDataFrame(rows, "row_idx long, prediction string, reference string")
    one, two = ({r[0]: r[1] for r in rouge.METRICS[m](pairs).select("row_idx", "hit").collect()} for m in ("rougeL", "rougeLsum"))
    assert one == two


def test_lsum_union(spark):
    # the published example of union LCS: a reference sentence against two predicted ones
    pairs = spark.createDataFrame([(0, "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5")], "row_idx long, prediction string, reference string")
    assert rouge.rouge_lsum(pairs).first()["hit"] == 4


def test_bootstrap(spark):
    rng = random.Random(5)
    values = [rng.random() for _ in range(200)]
    scores = spark.createDataFrame([(i, (v, v, v)) for i, v in enumerate(values)], f"row_idx long, score struct<{rouge.SCORE.replace(' double', ': double')}>")
    got = rouge.bootstrap(scores, seed=1).first()
    again = rouge.bootstrap(scores.repartition(3), seed=1).first()
    assert got["low"]["fmeasure"] == pytest.approx(again["low"]["fmeasure"], rel=1e-12)
    mean, error = sum(values) / 200, (sum((v - sum(values) / 200) ** 2 for v in values) / 199 / 200) ** 0.5
    assert got["mid"]["fmeasure"] == pytest.approx(mean, abs=error)
    assert got["low"]["fmeasure"] == pytest.approx(mean - 1.96 * error, abs=error / 2)
    assert got["high"]["fmeasure"] == pytest.approx(mean + 1.96 * error, abs=error / 2)


def plain_places(reference, prediction):
    rows = [[0] * (len(prediction) + 1) for _ in range(len(reference) + 1)]
    for i, x in enumerate(reference):
        for j, y in enumerate(prediction):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    i, j, out = len(reference), len(prediction), set()
    while i and j:
        if reference[i - 1] == prediction[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif rows[i][j - 1] > rows[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_places_against_plain():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert rouge.lcs_places(a, b) == plain_places(a, b)


def test_grams(spark):
    tokens = [["a", "b", "c", "d"], ["a"], [], ["a", "b"]]
    df = spark.createDataFrame([(t,) for t in tokens], "t array<string>")
    for n in (1, 2, 3):
        got = [r[0] for r in df.select(rouge.grams(F.col("t"), n)).collect()]
        assert got == [[" ".join(t[i : i + n]) for i in range(len(t) - n + 1)] for t in tokens]


def test_summary_of_all_four_metrics(spark, data):
    """The one-row summaries, from pairs scored one by one."""
    from collections import Counter

    from tessera.operators import selection
    from tessera.plans import queries

    def f(hit, p, r):
        return 2 * hit / (p + r) if hit else 0.0

    words = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
    rows = selection.first_rows(selection.split(queries.data(spark, data), "test"), 10).collect()
    for query, spaced in ((queries.rouge_summary, False), (queries.rouge_summary_compat, True)):
        sums = Counter()
        for r in rows:
            prediction = "\n".join((r["dialogue"] or "").split("\n")[:2])
            prediction = prediction.replace("", " ") if spaced else prediction.replace("<n>", " ")
            p, s = words(prediction), words(r["summary"])
            for n, name in ((1, "rouge1"), (2, "rouge2")):
                a, b = (Counter(zip(*[x[k:] for k in range(n)])) for x in (p, s))
                sums[name] += f(sum((a & b).values()), sum(a.values()), sum(b.values()))
            sums["rougeL"] += f(plain_lcs(p, s), len(p), len(s))
            ours, theirs, hits = Counter(p), Counter(s), 0
            for sentence in map(words, r["summary"].split("\n")):
                for i in sorted(set().union(*(plain_places(sentence, words(x)) for x in prediction.split("\n")))):
                    if ours[sentence[i]] and theirs[sentence[i]]:
                        ours[sentence[i]] -= 1
                        theirs[sentence[i]] -= 1
                        hits += 1
            sums["rougeLsum"] += f(hits, len(p), len(s))
        got = query(spark, data).first().asDict()
        assert got == pytest.approx({k: v / len(rows) for k, v in sums.items()}, abs=2e-6)
