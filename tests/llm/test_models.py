import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality

# language ID


def test_network_learns_and_repeats():
    rng = np.random.default_rng(1)
    rows = np.zeros((300, langid.WINDOW), np.uint8)
    target = np.arange(300) % 3
    for i, k in enumerate(target):
        rows[i, :80] = rng.choice(np.frombuffer([b"abcde ", b"cdefg ", b"xyz\xc3\xa9 "][k], np.uint8), 80)
    nets = [langid.ByteCNN(["a", "b", "c"], 3).fit(rows, target, steps=60) for _ in range(2)]
    p = nets[0].probabilities(rows)
    assert (p.argmax(axis=1) == target).mean() > 0.97 and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.array_equal(nets[0].dense, nets[1].dense)


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(2)
    rows, target = rng.integers(1, 255, (64, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 64)
    loss = lambda net: -np.log(net.probabilities(rows)[np.arange(64), target]).mean()
    assert loss(langid.ByteCNN(["a", "b"]).fit(rows, target, steps=60)) < 0.7 * loss(langid.ByteCNN(["a", "b"]))


def test_windows_cover_whole_texts():
    texts = [b"", b"a", b"b" * 256, b"c" * 600]
    rows, owner, used = langid.windows_of(texts)
    assert owner.tolist() == [1, 2, 3, 3, 3] and used.tolist() == [1, 256, 256, 256, 88]
    assert rows[4, :88].tobytes() == b"c" * 88 and not rows[4, 88:].any()


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = langid.identify(docs)
    assert made.count() == docs.count()
    held = made.where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert made.where("score < 0 or score > 1").count() == 0


def test_language_edge(spark, docs):
    import zlib

    rows = [(k, f"the thing and the other thing {k} of it", "en", "s", 1) for k in range(40)] + [(k, f"der die das und nicht ein {k} wird", "de", "s", 1) for k in range(40, 80)]
    rows += [(100, None, "en", "s", 1), (101, "", None, "s", 1), (102, "12 34 !!", "en", "s", 1), (103, "der und die das", None, "s", 1), (None, "the thing of it and", "de", "s", 1), (1, rows[1][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got if k is not None)
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103]["lang_pred"] == "de" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    assert langid.identify(df.limit(0)).count() == 0
    clash = df.withColumns({"lang_pred": F.lit("x"), "score": F.lit("y"), "held_out": F.lit(1)})
    kept = langid.accepted(clash, 0.4)
    assert kept.columns == clash.columns and kept.count() == len(rows) - 3 and kept.first()["lang_pred"] == "x"
    assert langid.accepted(df.withColumn("lang", F.lit(None).cast("string")), 0.4).count() == len(rows) - 3


def test_held_out_rows_teach_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert "zz" not in langid.fit(wrong, sample=50).labels


# quality


def test_statistics_against_plain(odd):
    extra = [(0, "a b a b a b"), (0, "x\n x\nx\n\n \nx"), (0, "#*$%&|<> !"), (0, "a b c a b c d"), (0, "\x1c \x85  ")]
    for _, text in odd + extra:
        assert quality.statistics(text)[:5] == brute.op2_statistics(text)


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (500, 4)), rng.normal(6, 1, (60, 4))
    both = np.concatenate((good, bad))
    forest = quality.IsolationForest(good, (both.min(axis=0), both.max(axis=0)))
    assert np.quantile(forest.score(good), 0.98) < forest.score(bad).min()
    none = quality.IsolationForest(np.zeros((0, 4)), (np.zeros(4), np.zeros(4)))
    assert none.score(good).max() == 0
    same = quality.IsolationForest(np.ones((9, 4)), (np.ones(4), np.ones(4)))
    assert len(set(same.score(good))) == 1


def test_verdicts(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    made = quality.judge(docs, labels)
    assert made.count() == docs.count() and made.where("kept and base_failed").count() == 0
    own = {(r[0], r[1]): r[2] for r in made.where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert own.get((1, False), 0) <= 0.01 * (own[1, True] + own.get((1, False), 0)) and own.get((0, False), 0) >= 4 * own.get((0, True), 0)


def test_quality_edge(spark, docs, odd):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 1, 0), (1, 1, 0), (7, 0, 0), (99, 5, 1), (12345, 0, 0)], "doc_id long, quality int, toxic int")
    clash = docs(odd).withColumns({c: F.lit(1) for c in ("n_words", "anomaly", "kept", "quality")})
    made = quality.judge(clash, labels.withColumn("n_words", F.lit(3))).collect()
    assert len(made) == len(odd) and all(r["base_failed"] for r in made if r["doc_id"] in (2, 3, 4, 5))
    base = quality.judge(docs(odd), labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in base)
    assert quality.judge(docs([]), labels).count() == 0


# plain versions, value by value


def plain_probabilities(net, window):
    act = []
    for f in range(len(net.width)):
        width, best = int(net.width[f]), -np.inf
        for at in range(len(window) - width + 1):
            best = max(best, sum(float(net.kernel[f, j] @ net.embed[window[at + j]]) for j in range(width)))
        act.append(max(0.0, best + float(net.bias[f])))
    z = np.array(act) @ net.dense.astype(float) + net.shift
    z = np.exp(z - z.max())
    return z / z.sum()


def test_forward_pass_against_plain():
    rng = np.random.default_rng(4)
    net = langid.ByteCNN(["a", "b", "c"], 5)
    net.bias, net.shift = rng.normal(0, 0.2, net.bias.shape).astype(np.float32), rng.normal(0, 0.2, 3).astype(np.float32)
    rows = rng.integers(1, 255, (3, langid.WINDOW)).astype(np.uint8)
    rows[1, 40:] = 0
    for row, got in zip(rows, net.probabilities(rows)):
        assert np.allclose(got, plain_probabilities(net, row), atol=1e-4)


def test_prediction_against_plain(spark, docs):
    net = langid.ByteCNN(["a", "b"], 6)
    texts = ["x", "word " * 100, "é" * 300, "12 ?", "", None, "\U0001f600 a"]
    got = {r["doc_id"]: r for r in langid.predicted(docs(list(enumerate(texts))).select("doc_id", "text"), net).collect()}
    for k, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        raw = t.encode()
        parts = [raw[i : i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
        p = sum(plain_probabilities(net, np.frombuffer(x.ljust(langid.WINDOW, b"\0"), np.uint8)) * len(x) for x in parts) / len(raw)
        assert got[k]["lang_pred"] == net.labels[int(p.argmax())] and abs(got[k]["score"] - p.max()) < 1e-4


def test_path_lengths_against_plain():
    rng = np.random.default_rng(7)
    good = rng.normal(0, 1, (300, 3))
    forest = quality.IsolationForest(good, (good.min(axis=0) - 1, good.max(axis=0) + 1), trees=7)

    def path(tree, row):
        feature, split, left, right, length = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[int(feature[at])] <= split[at] else right[at]
        return length[at]

    def expected(n):
        return 0 if n <= 1 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    rows = rng.normal(0, 3, (40, 3))
    want = [2 ** (-np.mean([path(t, r) for t in forest.trees]) / expected(256)) for r in rows]
    assert np.allclose(forest.score(rows), want)


def test_verdicts_against_plain(spark, data):
    """kept from the scores and labels, the threshold found by trying each."""
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    made = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    known = [(np.ceil(made[r["doc_id"]]["anomaly"] * quality.BINS), r["quality"]) for r in labels.where("quality in (0, 1)").collect() if r["doc_id"] in made]
    good, bad = [b for b, q in known if q == 1], [b for b, q in known if q == 0]
    share = lambda of, k: sum(b >= k for b in of) / len(of)
    fair = [k for k in range(quality.BINS + 1) if share(good, k) <= quality.GOOD_LOSS]
    best = max(round(share(bad, k) - share(good, k), 12) for k in fair)
    limit = (max(k for k in fair if round(share(bad, k) - share(good, k), 12) == best) - 1) / quality.BINS
    assert all(r["kept"] == (not r["base_failed"] and r["anomaly"] <= limit) for r in made.values())
    for r in docs.collect():
        words, chars, symbols, dup, repeat = brute.op2_statistics(r["text"])
        m = made[r["doc_id"]]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == (words, chars, symbols, dup, repeat)
        assert m["base_failed"] == (words < 50 or 100 * repeat > 50 * words)
