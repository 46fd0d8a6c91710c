"""Benchmark decontamination by template canonicalisation.

Texts are cut into words once. A number (its separators in it), a unit after a number and a
capitalised word become typed placeholders, so that a benchmark item whose numbers and names were
exchanged keeps its template. Windows of eight template words are hash-joined with those of the
items; windows on one alignment of document and item make a match, in which each value of the
item must be exchanged for one value of the document throughout, and no two for the same.
Besides, windows of thirteen plain lower-case words, or of all words of a shorter item, find
verbatim copies whatever their template is and however they are capitalised. A word is hashed
once for both, windows are hashes of these hashes, and all windows of a place take one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, table

WINDOW = 8
#: A match covers at least so many words of the item, or all of a shorter one.
MIN_WORDS = 13
#: A template window says something from so many plain words on; others of the item are left to verbatim windows.
LITERAL_WORDS = 2
#: The items' windows, or the documents' ids, are broadcast if they are at most so many rows (of under 64 bytes each).
BROADCAST_ROWS = 200_000
# Units that may follow a number.
UNITS = "km cm mm kg mg ml kwh mph kmh hour hours minute minutes second seconds day days week weeks month months year years mile miles meter meters metre metres dollar dollars euro euros cent cents percent m g l s h".split()
#: What stands for a number, a unit and a name; no word begins with it.
NUMBER, UNIT, NAME = "\x01n", "\x01u", "\x01a"
TEMPLATE, PLAIN = 0, 1
#: Stands for a point or comma between digits, which is part of a number.
JOINT = "·"
#: Between words: ASCII other than digits and letters, sign by sign, as ranges are slow to match.
BETWEEN = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]++"


def cut_words(text: Column) -> Column:
    """The words of a text as they stand, a number and the letters after it apart; there may be an empty one first and one last."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,](?=[0-9])", JOINT)
    return F.split(F.regexp_replace(joined, r"([0-9])(?=\p{L})", "$1 "), BETWEEN)


def is_number(word: Column) -> Column:
    return (word >= "0") & (word < ":")


def value_of(low: Column) -> Column:
    """What a placeholder's lower-case word is compared by: units without their plural."""
    return F.regexp_replace(low, r"(\p{L}{2})s$", "$1")


def hash_of(word: str) -> int:
    """What xxhash64() gives for it."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(word.encode(), 42), "big", signed=True)


def hashed_words(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, and the hashes of the plain and of the template words of ``text``: (plain, template)."""
    number, unit, name = (F.lit(hash_of(x)) for x in (NUMBER, UNIT, NAME))
    own = texts.select(*keep, cut_words(F.col("text")).alias("words")).withColumn("plain", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    own = own.withColumn("named", F.zip_with("words", "plain", lambda w, h: F.when((w >= "a") & (w < "{"), h).when(is_number(w), number).when(w.rlike(r"^\p{Lu}\p{Ll}+$"), name).otherwise(h)))  # most begin with a small letter
    measured = F.transform("named", lambda h, i: F.when(h.isin([hash_of(u) for u in UNITS]) & F.coalesce(F.get("named", i - 1) == number, F.lit(False)), unit).otherwise(h))
    return own.select(*keep, "plain", F.when(F.array_contains("named", number), measured).otherwise(F.col("named")).alias("template"))


def window_hash(kind: int, width: int, words: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(kind), F.lit(width), F.slice(words, at + 1, width))


def item_windows(items: DataFrame, size: int, least: int) -> DataFrame:
    """(hash, kind, width, item, i, n): the items' windows, template ones of ``size`` words and plain ones of ``least``, or of all words of a shorter item.

    Items of equal texts are one, that of the smallest item_id. Template windows of fewer than LITERAL_WORDS plain words say nothing.
    """
    own = items.where(F.col("text").isNotNull()).groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item"))
    empty = F.lit(hash_of(""))
    whole = hashed_words(own, "item").select("item", *[F.filter(c, lambda h: h != empty).alias(c) for c in ("plain", "template")]).where(F.size("plain") > 0)
    n = F.size("plain")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.least(F.lit(w), n).alias("width"), F.col(c).alias("words")) for k, w, c in ((TEMPLATE, size, "template"), (PLAIN, least, "plain"))])
    each = whole.select("item", n.alias("n"), F.explode(kinds).alias("x")).select("item", "n", "x.*").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))))
    part = F.slice("words", F.col("i") + 1, F.col("width"))
    literal = F.size(F.filter(part, lambda h: ~h.isin([hash_of(x) for x in (NUMBER, UNIT, NAME)])))
    each = each.where((F.col("kind") == PLAIN) | (literal >= LITERAL_WORDS))
    return each.select(F.xxhash64("kind", "width", part).alias("hash"), "kind", "width", "item", "i", "n")


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its rows are few; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


MATCHES = "doc_id long, item_id long, n_windows long, covered_words long, item_words long, coverage double, n_slots long, changed_slots long"


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, covered_words, item_words, coverage, n_slots, changed_slots): the items that documents hold.

    ``covered_words`` of the item's template are in matching windows on one alignment, at least
    ``min_words`` or all of a shorter item; values of placeholders must be exchanged one to one.
    Else a verbatim copy of the whole item, or of ``min_words`` in a row where values did not refuse
    the template, is a match, without slots. A document and an item give one row, that of the
    alignment that covers most. Null or empty texts match nothing; of items with equal texts the smallest item_id
    stands for all. Documents without a doc_id are matched and have a null one. Rows with one doc_id are one document.
    """
    body = F.coalesce("text", F.lit(""))
    own = docs.select(F.xxhash64("doc_id", body).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))
    windows = cut(item_windows(items, size, min_words))
    widths = sorted((r[0], r[1]) for r in windows.select("kind", "width").distinct().collect())  # at most ``size + min_words`` rows
    if not widths:
        return own.sparkSession.createDataFrame([], MATCHES)
    words = {TEMPLATE: F.col("template"), PLAIN: F.col("plain")}
    last = F.size("plain") - min(w for _, w in widths)
    at_each = hashed_words(own, "key", "doc_id").where(last >= 0).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    hashes = F.array(*[window_hash(k, w, words[k], F.col("at")) for k, w in widths])
    places = at_each.select("key", "doc_id", "at", F.explode(hashes).alias("hash"))
    found = places.join(_few(windows), "hash").withColumn("shift", F.col("at") - F.col("i"))
    aligned = found.groupBy("key", "doc_id", "kind", "item", "shift").agg(F.sort_array(F.collect_set("i")).alias("starts"), F.first("n").alias("n"), F.first("width").alias("width"))
    step = F.transform("starts", lambda x, k: F.when(k == 0, F.col("width")).otherwise(F.least(F.col("width"), x - F.get("starts", k - 1))))
    aligned = aligned.withColumn("covered", F.aggregate(step, F.lit(0), lambda a, x: a + x))
    good = cut(aligned.where(F.col("covered") >= F.least(F.lit(min_words), F.col("n"))))
    templates, plain = good.where(F.col("kind") == TEMPLATE), good.where(F.col("kind") == PLAIN)
    checked = cut(consistent(templates, own, items))
    refused = templates.join(checked, ["key", "item", "shift"], "left_anti").select("key", "item").distinct()
    whole, part = plain.where("covered = n"), plain.where("covered < n").join(refused, ["key", "item"], "left_anti").select(*plain.columns)
    verbatim = whole.unionByName(part).withColumn("n_slots", F.lit(0)).withColumn("changed", F.lit(0))
    every = checked.unionByName(verbatim.select(*checked.columns))
    best = F.min(F.struct((-F.col("covered")).alias("less"), "kind", "shift", "key", F.size("starts").alias("n_windows"), "covered", "n", "n_slots", "changed"))
    one = every.groupBy("doc_id", F.col("item").alias("item_id")).agg(best.alias("b"))
    longs = {"n_windows": "n_windows", "covered_words": "covered", "item_words": "n", "n_slots": "n_slots", "changed_slots": "changed"}
    out = one.select("doc_id", "item_id", *[F.col(f"b.{v}").cast("long").alias(k) for k, v in longs.items()], (F.col("b.covered") / F.col("b.n")).alias("coverage"))
    return out.select(*[c.split()[0] for c in MATCHES.split(", ")])


def consistent(good: DataFrame, own: DataFrame, items: DataFrame) -> DataFrame:
    """The alignments whose placeholders' values are exchanged one to one, with n_slots and changed."""
    marks = [hash_of(x) for x in (NUMBER, UNIT, NAME)]
    held = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item"), "text")
    named = hashed_words(held, "item", "text").select("item", F.filter("template", lambda h: h != hash_of("")).alias("template"), F.filter(F.transform(cut_words(F.col("text")), F.lower), lambda w: w != "").alias("item_values"))
    slotted = good.join(_few(named), "item")
    within = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("width") - 1))))
    slots = F.filter(within, lambda i: F.get("template", i).isin(marks))
    slotted = cut(slotted.withColumn("slots", slots).withColumn("there", F.transform("slots", lambda i: value_of(F.get("item_values", i)))).drop("item_values", "template"))
    plain = slotted.where(F.size("slots") == 0).withColumn("n_slots", F.lit(0)).withColumn("changed", F.lit(0)).drop("slots", "there")
    open_ = slotted.where(F.size("slots") > 0)
    if open_.isEmpty():
        return plain
    keys = _few(open_.select("key").distinct())
    texts = own.join(keys, "key", "left_semi").dropDuplicates(["key"]).select("key", F.transform(cut_words(F.col("text")), F.lower).alias("doc_values"))
    both = open_.join(texts, "key").withColumn("here", F.transform("slots", lambda i: value_of(F.get("doc_values", (i + F.col("shift")).cast("int"))))).drop("doc_values")
    pairs = F.array_distinct(F.arrays_zip("there", "here"))
    one_to_one = (F.size(pairs) == F.size(F.array_distinct("there"))) & (F.size(pairs) == F.size(F.array_distinct("here")))
    changed = F.size(F.filter(F.arrays_zip("there", "here"), lambda p: ~p["there"].eqNullSafe(p["here"])))
    kept = both.where(one_to_one).withColumn("n_slots", F.size("slots")).withColumn("changed", changed)
    return plain.unionByName(kept.select(*plain.columns))


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Rows without a doc_id can't be told apart and stay."""
    hit = cut(matches(docs, items, size, min_words).where("doc_id is not null").select("doc_id").distinct())
    return docs.join(_few(hit), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the benchmark items that documents hold."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(column: str) -> str:
    """The words, as :func:`cut_words` without empty ones; without looking around, neighbours are matched too, so a second pass joins what the first one left."""
    joined = f"coalesce({column}, '')"
    for _ in range(2):
        joined = rf"regexp_replace({joined}, '([0-9])[.,]([0-9])', '\1{JOINT}\2', 'g')"
    return rf"regexp_extract_all(regexp_replace({joined}, '([0-9])(\p{{L}})', '\1 \2', 'g'), '[^{BETWEEN[1:-3]}]+')"


_KIND_SQL = rf"CASE WHEN w >= '0' AND w < ':' THEN chr(1) || 'n' WHEN regexp_matches(w, '^\p{{Lu}}\p{{Ll}}+$') THEN chr(1) || 'a' WHEN lower(w) IN ({', '.join(f"'{u}'" for u in UNITS)}) AND before >= '0' AND before < ':' THEN chr(1) || 'u' ELSE lower(w) END"
_VALUE_SQL = r"regexp_replace(lower(w), '(\p{L}{2})s$', '\1')"

#: The same in SQL, a row for each word and each covered word.
ORACLE = f"""
WITH items AS (
  SELECT min(item_id) AS id, text FROM benchmark WHERE text IS NOT NULL GROUP BY text
), docs AS (
  SELECT row_number() OVER () AS id, doc_id, text FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
), cut AS (
  SELECT 'item' AS side, id, {_words_sql('text')} AS words FROM items UNION ALL SELECT 'doc', id, {_words_sql('text')} FROM docs
), each AS (
  SELECT side, id, words, unnest(range(1, len(words) + 1)) AS i FROM cut
), valued AS (
  SELECT side, id, i - 1 AS i, w, lower(w) AS low, {_KIND_SQL} AS mark, {_VALUE_SQL} AS value FROM (SELECT side, id, i, words[i] AS w, words[i - 1] AS before FROM each)
), listed AS (
  SELECT side, id, count(*) AS n, list(low ORDER BY i) AS plain, list(mark ORDER BY i) AS template FROM valued GROUP BY side, id
), kinds AS (
  SELECT side, id, n, 0 AS kind, {WINDOW} AS size, template AS words FROM listed UNION ALL SELECT side, id, n, 1, {MIN_WORDS}, plain FROM listed
), parts AS (
  SELECT id AS item, kind, n, least(size, n) AS width, words, unnest(range(0, n - least(size, n) + 1)) AS i FROM kinds WHERE side = 'item'
), windows AS (
  SELECT item, kind, n, width, i, array_to_string(list_slice(words, i + 1, i + width), ' ') AS w FROM parts
  WHERE kind = 1 OR len(list_filter(list_slice(words, i + 1, i + width), lambda x: NOT starts_with(x, chr(1)))) >= {LITERAL_WORDS}
), places AS (
  SELECT k.id, k.kind, x.width, k.words, unnest(range(0, greatest(0, k.n - x.width + 1))) AS at_ FROM kinds k JOIN (SELECT DISTINCT kind, width FROM windows) x ON k.kind = x.kind WHERE side = 'doc'
), hits AS (
  SELECT p.id AS doc, w.item, w.kind, w.n, w.width, w.i, p.at_ - w.i AS shift
  FROM (SELECT id, kind, width, at_, array_to_string(list_slice(words, at_ + 1, at_ + width), ' ') AS w FROM places) p JOIN windows w ON p.w = w.w AND p.width = w.width AND p.kind = w.kind
), starts AS (
  SELECT doc, item, kind, n, shift, count(DISTINCT i) AS n_windows FROM hits GROUP BY ALL
), covered AS (
  SELECT DISTINCT doc, item, kind, shift, unnest(range(i, i + width)) AS pos FROM hits
), slots AS (
  SELECT c.doc, c.item, c.kind, c.shift, CASE WHEN c.kind = 0 AND starts_with(t.mark, chr(1)) THEN t.value END AS there, h.value AS here
  FROM covered c JOIN valued t ON t.side = 'item' AND t.id = c.item AND t.i = c.pos JOIN valued h ON h.side = 'doc' AND h.id = c.doc AND h.i = c.pos + c.shift
), counted AS (
  SELECT doc, item, kind, shift, count(*) AS covered, count(there) AS n_slots, count(*) FILTER (WHERE there <> here) AS changed,
         count(DISTINCT there || chr(3) || here) AS pairs, count(DISTINCT there) AS theres, count(DISTINCT CASE WHEN there IS NOT NULL THEN here END) AS heres
  FROM slots GROUP BY ALL
), good AS (
  SELECT s.*, c.covered, c.n_slots, c.changed, c.pairs = c.theres AND c.pairs = c.heres AS same FROM starts s JOIN counted c USING (doc, item, kind, shift) WHERE c.covered >= least({MIN_WORDS}, s.n)
), fine AS (
  SELECT * FROM good g WHERE same AND (kind = 0 OR covered = n OR NOT EXISTS (SELECT 1 FROM good r WHERE r.doc = g.doc AND r.item = g.item AND r.kind = 0 AND NOT r.same))
) SELECT doc_id, item AS item_id, CAST(n_windows AS BIGINT) AS n_windows, CAST(covered AS BIGINT) AS covered_words, CAST(n AS BIGINT) AS item_words, covered / n AS coverage,
         CAST(n_slots AS BIGINT) AS n_slots, CAST(changed AS BIGINT) AS changed_slots
FROM (SELECT d.doc_id, f.*, row_number() OVER (PARTITION BY d.doc_id, f.item ORDER BY f.covered DESC, f.kind, f.shift) AS r FROM fine f JOIN docs d ON d.id = f.doc) WHERE r = 1
"""
