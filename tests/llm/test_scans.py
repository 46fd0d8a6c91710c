import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, licenses, sharding

BENCH = "item_id long, text string"
LONG = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"


# licenses

LICENSE_ROWS = [
    (1, "Released under the MIT License."), (2, None), (3, ""), (4, "...  MIT license; mit LICENSE, apache\nlicense CC BY-NC 4.0"), (5, "GNU general  public license" + " word" * 90 + " gnu general public licens"),
    (6, "licenſe mİt license Kit license"), (7, "Licensed under the Apache License, Version 2.0. " * 40), (8, "mit"), (9, "license mit license mit license"),
    (10, "Redistribution and use in source and binary forms, with modification, are permitted"), (11, "word " * 3000 + "Permission is hereby granted, free of charge, to any person obtaining this software and documentation files"),
]


def test_licenses_against_plain(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs(LICENSE_ROWS)).collect()}
    for k, text in LICENSE_ROWS:
        n, places, first, last, base = brute.op7_base(text, licenses.PHRASES)
        own, best = brute.op7_method(text, licenses.TEMPLATES, licenses.COMMON, licenses.block_of)
        labels = ",".join(sorted(own | set(filter(None, base.split(",")))))
        assert tuple(got[k])[1:] == (n, places, first, last, base, labels, 1.0 if places else best), k


def test_templates_of_any_size_are_found_anywhere(docs):
    sizes = (3, 21, 64, 400)
    templates = [(" ".join(f"t{n}x{k}" for k in range(n)), f"own{n}") for n in sizes]
    rows = [(1000 * n + at, "word " * at + text + " word" * 90) for n, (text, _) in zip(sizes, templates) for at in (0, 1, 16, 31, 33, 63, 64, 100, 129, 511, 700)]
    rows += [(1000 * n + 999, "word " * 20 + " ".join(text.split()[: n * 4 // 5 - 1])) for n, (text, _) in zip(sizes, templates)]
    made = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs(rows), templates).collect()}
    assert made == {k: ("", 0.0) if k % 1000 == 999 else (f"own{k // 1000}", 1.0) for k, _ in rows}


def test_whole_license_texts(docs):
    rows = [(k, "some words before it. " * 30 + wording + " and after") for k, (wording, _) in enumerate(licenses.TEMPLATES)]
    made = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    assert all(label in made[k]["labels"].split(",") and made[k]["score"] == 1.0 for k, (_, label) in enumerate(licenses.TEMPLATES))


def test_licenses_edge(docs):
    assert licenses.scan(docs([])).count() == 0
    made = licenses.scan(docs([(1, "mit license"), (1, "mit license"), (None, "mit license")]).withColumns({c: F.lit(1) for c in ("row", "hits", "w", "n_words", "labels")}))
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in made.collect()) == [(0, "mit"), (1, "mit"), (1, "mit")]


def test_licenses_native(docs):
    assert "Python" not in licenses.scan(docs(LICENSE_ROWS))._jdf.queryExecution().executedPlan().toString()


# decontamination


def found(docs, spark, rows, items):
    return {(r["doc_id"], r["item_id"]): r for r in decontamination.matches(docs(rows), spark.createDataFrame(items, BENCH)).collect()}


def test_literal_items(docs, spark):
    words = LONG.split()
    rows = [
        (1, f"Before it. {LONG} after"), (2, LONG.upper()), (3, " ".join(words[:12])), (4, " ".join(words[:13])), (5, " ".join(words[:8] + ["x"] + words[9:])),
        (6, "nothing at all here"), (7, None), (8, ""), (9, " ".join(reversed(words))), (1, f"Before it. {LONG} after"), (10, ", ".join(words)), (None, LONG),
    ]
    got = found(docs, spark, rows, [(0, LONG), (1, None), (2, ""), (3, LONG), (4, "zulu yankee")])
    assert set(got) == {(k, 0) for k in (1, 2, 4, 5, 10, None)}
    assert got[1, 0]["covered_words"] == 20 and got[4, 0]["covered_words"] == 13 and got[4, 0]["n_windows"] == 6


def test_short_items_match_whole(docs, spark):
    got = found(docs, spark, [(1, "so what is the largest ocean on earth then"), (2, "what is the largest"), (3, "what is the largest ocean")], [(7, "What is the largest ocean?"), (8, "then")])
    assert set(got) == {(1, 7), (3, 7), (1, 8)}


def test_exchanged_values_must_be_consistent(docs, spark):
    item = "a train leaves at 5 and then Alice walks for 7 km until she meets Bob who left at 5 after Alice had gone"
    same = item.replace("5", "9").replace("7", "11").replace("Alice", "Carol").replace("Bob", "Dave")
    mixed = item.replace("left at 5", "left at 6").replace("7", "11")
    merged = item.replace("7", "5")
    other_unit = item.replace("km", "miles")
    got = found(docs, spark, [(1, same), (2, mixed), (3, merged), (4, item), (5, other_unit)], [(0, item)])
    assert set(got) == {(1, 0), (4, 0), (5, 0)}
    assert got[1, 0]["changed_slots"] == 6 and got[4, 0]["changed_slots"] == 0 and got[5, 0]["changed_slots"] == 1 and got[1, 0]["n_slots"] == 7


def test_verbatim_copies_of_numbers_and_names(docs, spark):
    items = [(0, "What is 12 + 30 * 4 - 7 + 9?"), (1, "Compute the sum of 12, 30, 4, 7, 9, 15, 22, 31 and 48.")]
    rows = [(1, f"some words before. {items[0][1]} And after"), (2, f"some words before. {items[1][1]} And after"), (3, "What is 12 + 30 * 4 - 7 + 8?"), (4, "Compute the sum of 12, 30, 4, 7, 9, 15, 22")]
    assert set(found(docs, spark, rows, items)) == {(1, 0), (2, 1)}
    assert {r["doc_id"] for r in decontamination.clean(docs(rows), spark.createDataFrame(items, BENCH)).collect()} == {3, 4}


def test_short_copies_after_running_text(docs, spark):
    items = [(0, "What is the capital of France?"), (1, "Name the largest ocean.")]
    rows = [(1, f"words Here {items[0][1]} And more"), (2, f"words here {items[1][1].upper()}"), (3, f"In as Et une {items[1][1]}"), (4, "words Here What is the capital of")]
    assert set(found(docs, spark, rows, items)) == {(1, 0), (2, 1), (3, 1)}


LOOSE = [
    ("Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have?", "Anna has 7 apples. Anna buys 4 more apples. How many apples does Anna have?", "Anna has 7 apples. Anna buys 4 more apples. How many apples does Emma have?"),
    ("A farmer sells 1,200 eggs in a week. How many are sold each day?", "A farmer sells 950 eggs in a week. How many are sold each day?", "A farmer sells 950 hens in a week. Who knows what they cost?"),
    ("A pump fills 3.5 tanks while another one empties 2 tanks, so how many are full?", "A pump fills 4 tanks while another one empties 1,250 tanks, so how many are full?", "A pump fills 4 tanks while another one empties 4 tanks, so how many are full?"),
    ("the first walk takes 1 hour and the second walk takes 3 hours so how long are both", "the first walk takes 2 hours and the second walk takes 3 hours so how long are both", "the first walk takes 3 hours and the second walk takes 3 hours so how long are both"),
]


def test_ordinary_exchanges(docs, spark):
    rows = [(10 * i + k, f"text before it. {text} And text after it") for i, (_, *texts) in enumerate(LOOSE) for k, text in enumerate(texts)]
    assert set(found(docs, spark, rows, [(i, x[0]) for i, x in enumerate(LOOSE)])) == {(10 * i, i) for i in range(len(LOOSE))}


ODD_ITEMS = [(k, t) for k, t in enumerate([
    "Tom runs 10 km in 2 hours", "What is 9.5 plus 1,200 of the 3 apples that Tom and Anna and Tom again have now?", "Alice sells sea shells by the sea shore and Bob buys them for 3 dollars", "5km or 7.5 miles",
    "One two three four five six seven eight nine ten eleven twelve thirteen fourteen", LONG, "Ñandú corre 5 km", "12, 13, 14 and 15",
])]
ODD_TEXTS = [t for _, t in ODD_ITEMS] + [
    "Tom runs 10 km in 2 hours", "well Anna runs 12 miles in 3 days then", "anna runs 12 km in 3 hours", "Tom runs 10 km in 10 hours", "so tom runs 10 km in 2 hours.", "What is 8 plus 950.25 of the 4 apples that Ann and Eve and Ann again have now?",
    "What is 8 plus 950.25 of the 4 apples that Ann and Eve and Eve again have now?", "alice sells sea shells by the sea shore and bob buys them for 3 dollars", "Carol sells sea shells by the sea shore and Dave buys them for 30 dollars", "6km or 8 miles", "6 km or 8 km", "6km or 8 Miles?",
    "x ONE two THREE four five six seven eight nine ten eleven twelve thirteen x", "x One two three four five six seven x nine ten eleven twelve thirteen fourteen", "ñandú corre 5 km", "Zorro corre 9km", "1,2 and.3 x2.5y 5é 1.2.3,4. A.B 12, 13, 14 and 15", "12 13 14 and 16", None, "", " . ", "7",
]


def test_templates_against_plain(docs, spark):
    rows = list(enumerate(ODD_TEXTS))
    got = {k: (r["covered_words"], r["n_slots"], r["changed_slots"]) for k, r in found(docs, spark, rows, ODD_ITEMS).items()}
    assert got == brute.op4_slots(rows, ODD_ITEMS)
    assert {(8, 0), (9, 0), (12, 0), (13, 1), (15, 2), (16, 2)} <= set(got) and not {(11, 0), (14, 1), (17, 3)} & set(got)  # the last has one plain word only


def test_templates_against_sql(docs, spark, duck):
    import pandas as pd

    rows = [*enumerate(ODD_TEXTS), (3, ODD_TEXTS[3]), (4, "Tom runs 10 km in 2 hours")]
    own = duck.cursor()
    texts, items = pd.DataFrame(rows, columns=["doc_id", "text"]), pd.DataFrame([*ODD_ITEMS, (50, LONG), (51, None), (52, "")], columns=["item_id", "text"])
    own.execute("create temp table documents as select * from texts")
    own.execute("create temp table benchmark as select * from items")
    made = decontamination.matches(docs(rows), spark.createDataFrame([*ODD_ITEMS, (50, LONG), (51, None), (52, "")], BENCH))
    assert sorted(map(tuple, made.collect())) == sorted(own.sql(decontamination.ORACLE).fetchall())


def test_decontamination_native(docs, spark):
    assert "Python" not in decontamination.matches(docs([(1, LONG)]), spark.createDataFrame([(0, LONG)], BENCH))._jdf.queryExecution().executedPlan().toString()


def test_decontamination_against_plain(docs, spark, data):
    own = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(found(docs, spark, own, items)) == brute.op4(own, items)


def test_decontamination_edge(docs, spark):
    items = spark.createDataFrame([(0, LONG)], BENCH)
    assert decontamination.matches(docs([]), items).count() == 0
    assert decontamination.matches(docs([(1, LONG)]), items.limit(0)).count() == 0
    clash = docs([(1, LONG), (2, "clean"), (None, LONG)]).withColumns({c: F.lit(1) for c in ("key", "item", "hash", "at", "words", "item_id")})
    assert {r[0] for r in decontamination.matches(clash, items.withColumn("doc_id", F.lit(4))).select("doc_id").collect()} == {1, None}
    kept = decontamination.clean(clash, items)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {2, None}


def test_decontamination_without_broadcast(docs, spark, monkeypatch):
    rows, items = [(1, LONG), (2, "clean")], [(0, LONG)]
    want = set(found(docs, spark, rows, items))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    assert set(found(docs, spark, rows, items)) == want


# sharding


def test_sharding_agrees_with_sql(agrees):
    agrees(sharding.query, sharding.ORACLE)


def test_fill_is_even_and_stable():
    names = sharding.shard_names(20)
    full = sharding.fill(names, 2003)
    sizes = [full.count(k) for k in range(20)]
    assert max(sizes) - min(sizes) <= 1
    less = sharding.fill(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(full, less) if a != 19)
    assert moved < 0.25 * 2003
    with pytest.raises(ValueError, match="prime"):
        sharding.fill(names, 2001)
    with pytest.raises(ValueError, match="different"):
        sharding.fill(["a", "a"], 2003)


def test_sharding_edge(spark, tmp_path):
    rows = [(i, "hot", None) for i in range(300)] + [(i, f"k{i}", "x") for i in range(300, 400)] + [(None, None, "x"), (401, None, "x"), (401, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    plain = sharding.shard(df, "source", sharding.shard_names(8), 101)
    assert plain.where("source = 'hot'").select("shard").distinct().count() == 1
    assert plain.where("source is null").select("shard").distinct().count() == 1 and plain.count() == len(rows)
    spread = sharding.shard(df, "source", sharding.shard_names(8), 101, spread="doc_id")
    assert spread.count() == len(rows) and spread.where("source = 'hot'").select("shard").distinct().count() == 8
    assert sharding.shard(df.limit(0), "source", sharding.shard_names(8), 101, spread="doc_id").count() == 0
    sharding.write(spread, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == spread.select("shard").distinct().count()


def test_sharding_with_clashing_columns(spark):
    rows = [(i, "hot", i) for i in range(300)] + [(i, None, i) for i in range(300, 400)]
    plain = spark.createDataFrame(rows, "doc_id long, source string, extra long")
    clash = plain.withColumns({c: F.lit(7) for c in ("_hot", "_is_hot", "hot", "is_hot", "by", "row", "spread", "_n", "_all", "_k", "slot")})
    made = sharding.shard(clash, "source", sharding.shard_names(8), 101, spread="doc_id")
    assert sorted(made.columns) == sorted({*clash.columns, "shard"}) and made.where("_hot = 7 and by = 7 and row = 7").count() == len(rows)
    want = sharding.shard(plain, "source", sharding.shard_names(8), 101, spread="doc_id")
    assert sorted(made.select("doc_id", "slot", "shard").collect()) == sorted(want.select("doc_id", "slot", "shard").collect())


def test_hot_null_source_is_spread(spark, duck):
    rows = [(i, None if i % 3 == 0 else f"k{i}") for i in range(900)]
    sharded = sharding.shard(spark.createDataFrame(rows, "doc_id long, source string"), "source", sharding.shard_names(), spread="doc_id")
    assert sharded.columns == ["doc_id", "source", "slot", "shard"]
    own = duck.cursor()
    own.execute("create temp table documents as select i as doc_id, case when i % 3 <> 0 then 'k' || i end as source from range(900) t(i)")
    assert sorted(map(tuple, sharded.collect()), key=str) == sorted(own.sql(sharding.ORACLE).fetchall(), key=str)
    assert sharded.where("source is null").select("shard").distinct().count() > 16
