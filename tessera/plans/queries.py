"""The queries over the driver's tables and the SQL that each must agree with. Arrays are shown as comma-joined text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rouge
from ..functions.text import replace_newline_token
from ..operators import evaluation, features, selection, validation
from ..operators.summarizers import Lead, TfIdf
from ..sources import archives, dialogues

REQUIRED = ("AFRICA", "AMERICA", "ASIA")
CAP, SOURCE_CAP, TARGET_CAP, BATCH = 64, 1024, 128, 16
TOKEN = "<n>"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def data(spark: SparkSession, d: str) -> DataFrame:
    return dialogues.dataset(table(spark, d, "conversations"))


def shown(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",").alias(ids)


def dialogue_assembly(spark, d):
    return data(spark, d).select("split", "row_idx", "conv_id", "dialogue", "summary")


def split_counts(spark, d):
    return selection.counts(dialogues.assemble(table(spark, d, "conversations")))


def eval_slice(spark, d):
    return selection.first_rows(selection.split(data(spark, d), "test"), 10).select("row_idx", "dialogue", "summary")


def train_slice(spark, d):
    return selection.first_rows(selection.split(data(spark, d), "train"), 10).select("row_idx", "dialogue", "summary")


def point_lookup(spark, d):
    return selection.row(data(spark, d), 1).select("split", "row_idx", "dialogue", "summary")


def paired_columns(spark, d):
    return selection.pair(data(spark, d), "dialogue", "summary")


def zipped_batches(spark, d):
    own = data(spark, d)
    left = selection.batches(own.withColumnRenamed("dialogue", "text"), BATCH, ["text"]).withColumnRenamed("batch_id", "row_idx")
    right = selection.batches(own, BATCH, ["summary"]).withColumnRenamed("batch_id", "row_idx").drop("n")
    both = selection.zip_rows(left, right)
    return both.select("split", F.col("row_idx").alias("batch_id"), "n", F.length(F.array_join("text", "")).cast("long").alias("text_chars"), F.length(F.array_join("summary", "")).cast("long").alias("summary_chars"))


def batch_chunks(spark, d):
    made = selection.batches(data(spark, d), BATCH, ["summary"])
    return made.select("split", "batch_id", "n", F.array_join("summary", "\n").alias("summaries"))


def batch_counts(spark, d):
    return selection.batch_counts(dialogues.assemble(table(spark, d, "conversations")), BATCH)


def vocabulary(spark, d):
    return features.vocabulary(selection.split(data(spark, d), "train"), ["dialogue", "summary"])


def _features(spark, d, cap: int = SOURCE_CAP) -> tuple[DataFrame, DataFrame]:
    own = data(spark, d)
    vocab = features.vocabulary(selection.split(own, "train"), ["dialogue", "summary"])
    return features.features(own, vocab, max_source=cap), vocab


def feature_truncate(spark, d):
    return _features(spark, d, CAP)[0].select("split", "row_idx", shown("input_ids"))


def attention_mask(spark, d):
    return _features(spark, d)[0].select("split", "row_idx", F.size("attention_mask").cast("long").alias("n"), shown("attention_mask"))


def labels(spark, d):
    return _features(spark, d)[0].select("split", "row_idx", shown("labels"))


def model_inputs(spark, d):
    own = selection.model_inputs(_features(spark, d)[0])
    return own.agg(F.count("*").alias("rows"), *[F.sum(F.size(c)).cast("long").alias(c) for c in own.columns])


def pad_max_length(spark, d):
    made = features.padded(_features(spark, d)[0], SOURCE_CAP)
    return made.select("split", "row_idx", shown("input_ids"), shown("attention_mask"))


def collate_dynamic(spark, d):
    made = features.collated(_features(spark, d)[0], BATCH)
    return made.select("split", "row_idx", "batch_id", shown("input_ids"), shown("attention_mask"), shown("labels"))


def decode(spark, d):
    made, vocab = _features(spark, d)
    return features.decode(made, "labels", vocab)


def interleave_compat(spark, d):
    return data(spark, d).select("split", "row_idx", replace_newline_token(F.col("summary"), "").alias("spaced"))


def newline_replace(spark, d):
    marked = F.replace(F.col("dialogue"), F.lit("\n"), F.lit(TOKEN))
    return data(spark, d).select("split", "row_idx", replace_newline_token(marked, TOKEN).alias("plain"))


def lead_summary(spark, d):
    return Lead(2).summarize(data(spark, d), "dialogue").select("split", "row_idx", "prediction")


def tfidf_summary(spark, d):
    own = data(spark, d)
    return TfIdf.fit(selection.split(own, "train"), "dialogue").summarize(own, "dialogue").select("split", "row_idx", "prediction")


def predict_one(spark, d):
    one = selection.row(selection.split(data(spark, d), "test"), 0)
    return Lead(2).summarize(one, "dialogue").select(F.col("prediction").alias("summary_text"))


def _pairs(spark, d, newline_token: str = TOKEN) -> DataFrame:
    made = Lead(2).summarize(dialogues.assemble(table(spark, d, "conversations")), "dialogue")
    return made.select("conv_id", replace_newline_token(F.col("prediction"), newline_token).alias("prediction"), F.col("summary").alias("reference"))


def _scores(made: DataFrame) -> DataFrame:
    return made.select("conv_id", "hit", "n_pred", "n_ref", "score.precision", "score.recall", "score.fmeasure")


def rouge1(spark, d):
    return _scores(rouge.rouge_n(_pairs(spark, d), 1, key="conv_id"))


def rouge2(spark, d):
    return _scores(rouge.rouge_n(_pairs(spark, d), 2, key="conv_id"))


def rouge1_compat(spark, d):
    return _scores(rouge.rouge_n(_pairs(spark, d, ""), 1, key="conv_id"))


def rouge_l(spark, d):
    return _scores(rouge.rouge_l(_pairs(spark, d), key="conv_id"))


def rouge_lsum(spark, d):
    return _scores(rouge.rouge_lsum(_pairs(spark, d), key="conv_id"))


def rouge_mid(spark, d):
    return rouge.mean(rouge.rouge_n(_pairs(spark, d), 1, key="conv_id"))


def rouge_bootstrap(spark, d):
    made = rouge.bootstrap(rouge.rouge_n(_pairs(spark, d), 1, key="conv_id"), key="conv_id")
    return made.select(*[F.round(f"{x}.fmeasure", 6).alias(x) for x in ("low", "mid", "high")])


def rouge_summary(spark, d):
    test = selection.first_rows(selection.split(data(spark, d), "test"), 10)
    return evaluation.evaluate(test, Lead(2), TOKEN)


def rouge_summary_compat(spark, d):
    test = selection.first_rows(selection.split(data(spark, d), "test"), 10)
    return evaluation.evaluate(test, Lead(2), "")


def _entries(spark, d) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("ord"))


def validate_compat(spark, d):
    return validation.status_compat(_entries(spark, d), list(REQUIRED))


def validate_strict(spark, d):
    return validation.status_strict(_entries(spark, d), list(REQUIRED))


def validate_unexpected(spark, d):
    return validation.unexpected(_entries(spark, d), list(REQUIRED)).select("name")


def validate_missing(spark, d):
    return validation.missing(_entries(spark, d), [*REQUIRED, "ATLANTIS"])


def size_kb(spark, d):
    return table(spark, d, "documents").select("doc_id", archives.size_kb(F.octet_length("text")).alias("size"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dialogue_assembly, split_counts, eval_slice, train_slice, point_lookup, paired_columns, zipped_batches, batch_chunks, batch_counts, vocabulary, feature_truncate, attention_mask, labels, model_inputs,
        pad_max_length, collate_dynamic, decode, interleave_compat, newline_replace, lead_summary, tfidf_summary, predict_one, rouge1, rouge2, rouge1_compat, rouge_l, rouge_lsum, rouge_mid, rouge_bootstrap,
        rouge_summary, rouge_summary_compat, validate_compat, validate_strict, validate_unexpected, validate_missing, size_kb,
    )
}

DATA = """WITH turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
), assembled AS (
  SELECT conv_id, CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
         string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) FILTER (WHERE back > 1) AS dialogue,
         max(text) FILTER (WHERE back = 1) AS summary
  FROM turns WHERE n >= 2 GROUP BY conv_id
), data AS (
  SELECT split, row_number() OVER (PARTITION BY split ORDER BY conv_id) - 1 AS row_idx, conv_id, dialogue, summary FROM assembled
)"""
WORDS = DATA + f""", vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY token) + 2 AS INTEGER) AS id
  FROM (SELECT DISTINCT unnest(list_concat(regexp_extract_all(dialogue, '\\S+'), regexp_extract_all(summary, '\\S+'))) AS token FROM data WHERE split = 'train')
), capped AS (
  SELECT split, row_idx, 'input_ids' AS kind, list_slice(regexp_extract_all(dialogue, '\\S+'), 1, {SOURCE_CAP - 1}) AS words FROM data
  UNION ALL SELECT split, row_idx, 'short', list_slice(regexp_extract_all(dialogue, '\\S+'), 1, {CAP - 1}) FROM data
  UNION ALL SELECT split, row_idx, 'labels', list_slice(regexp_extract_all(summary, '\\S+'), 1, {TARGET_CAP - 1}) FROM data
), placed AS (
  SELECT split, row_idx, kind, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM capped
), encoded AS (
  SELECT c.split, c.row_idx, c.kind, list_append(coalesce(x.ids, []), 1) AS ids
  FROM capped c LEFT JOIN (
    SELECT split, row_idx, kind, list(coalesce(id, 2) ORDER BY pos) AS ids FROM placed LEFT JOIN vocab USING (token) GROUP BY split, row_idx, kind
  ) x ON c.split = x.split AND c.row_idx = x.row_idx AND c.kind = x.kind
)"""
LEAD = "array_to_string(list_slice(string_split(dialogue, chr(10)), 1, 2), chr(10))"
COMMAS = "array_to_string({}, ',')"


def _pairs_sql(prediction: str) -> str:
    return DATA + f""", pairs AS (
  SELECT conv_id, row_idx, split, regexp_extract_all(lower({prediction}), '[a-z0-9]+') AS p, regexp_extract_all(lower(summary), '[a-z0-9]+') AS r FROM data
)"""


def _grams_sql(n: int, prediction: str = LEAD) -> str:
    gram = lambda c: f"list_transform(range(1, greatest(1, len({c}) - {n - 2})), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))"
    return _pairs_sql(prediction) + f""", sized AS (
  SELECT conv_id, row_idx, split, {gram('p')} AS p, {gram('r')} AS r FROM pairs
), each AS (
  SELECT conv_id, unnest(p) AS g, 1 AS own, 0 AS other FROM sized UNION ALL SELECT conv_id, unnest(r), 0, 1 FROM sized
), counted AS (
  SELECT conv_id, g, least(sum(own), sum(other)) AS hit FROM each GROUP BY conv_id, g
), hits AS (
  SELECT s.conv_id, s.row_idx, s.split, CAST(coalesce(h.hit, 0) AS BIGINT) AS hit, CAST(len(s.p) AS BIGINT) AS n_pred, CAST(len(s.r) AS BIGINT) AS n_ref
  FROM sized s LEFT JOIN (SELECT conv_id, sum(hit) AS hit FROM counted GROUP BY conv_id) h ON s.conv_id = h.conv_id
)"""


SCORED = """, parts AS (
  SELECT *, CASE WHEN n_pred > 0 THEN hit / n_pred ELSE 0.0 END AS precision, CASE WHEN n_ref > 0 THEN hit / n_ref ELSE 0.0 END AS recall FROM hits
), scored AS (
  SELECT *, CASE WHEN hit > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS fmeasure FROM parts
)"""
SCORES = SCORED + " SELECT conv_id, hit, n_pred, n_ref, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(fmeasure AS DOUBLE) AS fmeasure FROM scored"
SPACED = "CASE WHEN {0} = '' THEN ' ' ELSE ' ' || array_to_string(regexp_extract_all({0}, '(?s).'), ' ') || ' ' END"
LCS = _pairs_sql(LEAD) + """, hits AS (
  SELECT conv_id, CAST(list_reduce(
    list_prepend(list_transform(range(len(r) + 1), lambda z: 0), list_transform(p, lambda t: list_prepend(0, list_transform(r, lambda y: CASE WHEN y = t THEN 1 ELSE 0 END)))),
    lambda prev, same: list_reduce(
      list_prepend([0], list_transform(range(2, len(same) + 1), lambda j: [same[j], prev[j - 1], prev[j]])),
      lambda row, c: list_append(row, CASE WHEN c[1] = 1 THEN c[2] + 1 ELSE greatest(c[3], row[len(row)]) END))
  )[len(r) + 1] AS BIGINT) AS hit, CAST(len(p) AS BIGINT) AS n_pred, CAST(len(r) AS BIGINT) AS n_ref FROM pairs
)""" + SCORES
TFIDF = DATA + """, total AS (
  SELECT count(*) AS n FROM data WHERE split = 'train'
), freq AS (
  SELECT token, count(*) AS df FROM (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(dialogue), '[a-z0-9]+')) AS token FROM data WHERE split = 'train') GROUP BY token
), lines AS (
  SELECT split, row_idx, unnest(string_split(dialogue, chr(10))) AS line, generate_subscripts(string_split(dialogue, chr(10)), 1) AS pos FROM data
), tokens AS (
  SELECT split, row_idx, pos, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS token FROM lines
), weights AS (
  SELECT split, row_idx, pos, round(avg(ln(CAST(1 + n AS DOUBLE) / (1 + df)) + 1), 6) AS w FROM tokens JOIN freq USING (token), total GROUP BY split, row_idx, pos
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.split, l.row_idx ORDER BY coalesce(w.w, 0) DESC, l.pos) AS r
  FROM lines l LEFT JOIN weights w ON l.split = w.split AND l.row_idx = w.row_idx AND l.pos = w.pos
) SELECT split, row_idx, string_agg(line, chr(10) ORDER BY pos) AS prediction FROM ranked WHERE r <= 2 GROUP BY split, row_idx"""
BATCHED = f"(row_idx // {BATCH})"

ORACLES: dict[str, str] = {
    "dialogue_assembly": f"{DATA} SELECT split, row_idx, conv_id, dialogue, summary FROM data",
    "split_counts": f"{DATA} SELECT split, count(*) AS n FROM data GROUP BY split",
    "eval_slice": f"{DATA} SELECT row_idx, dialogue, summary FROM data WHERE split = 'test' AND row_idx < 10",
    "train_slice": f"{DATA} SELECT row_idx, dialogue, summary FROM data WHERE split = 'train' AND row_idx < 10",
    "point_lookup": f"{DATA} SELECT split, row_idx, dialogue, summary FROM data WHERE row_idx = 1",
    "paired_columns": f"{DATA} SELECT split, row_idx, dialogue AS text, summary FROM data",
    "zipped_batches": f"{DATA} SELECT split, {BATCHED} AS batch_id, count(*) AS n, CAST(sum(length(dialogue)) AS BIGINT) AS text_chars, CAST(sum(length(summary)) AS BIGINT) AS summary_chars FROM data GROUP BY split, {BATCHED}",
    "batch_chunks": f"{DATA} SELECT split, {BATCHED} AS batch_id, count(*) AS n, string_agg(summary, chr(10) ORDER BY row_idx) AS summaries FROM data GROUP BY split, {BATCHED}",
    "batch_counts": f"{DATA} SELECT split, (count(*) + {BATCH - 1}) // {BATCH} AS batches FROM data GROUP BY split",
    "vocabulary": f"{WORDS} SELECT token, id FROM vocab",
    "feature_truncate": f"{WORDS} SELECT split, row_idx, {COMMAS.format('ids')} AS input_ids FROM encoded WHERE kind = 'short'",
    "attention_mask": f"{WORDS} SELECT split, row_idx, CAST(len(ids) AS BIGINT) AS n, {COMMAS.format('list_transform(ids, lambda x: 1)')} AS attention_mask FROM encoded WHERE kind = 'input_ids'",
    "labels": f"{WORDS} SELECT split, row_idx, {COMMAS.format('ids')} AS labels FROM encoded WHERE kind = 'labels'",
    "model_inputs": f"{WORDS} SELECT (SELECT count(*) FROM data) AS rows, CAST(sum(len(ids)) FILTER (WHERE kind = 'input_ids') AS BIGINT) AS input_ids, CAST(sum(len(ids)) FILTER (WHERE kind = 'input_ids') AS BIGINT) AS attention_mask, CAST(sum(len(ids)) FILTER (WHERE kind = 'labels') AS BIGINT) AS labels FROM encoded",
    "pad_max_length": f"{WORDS} SELECT split, row_idx, {COMMAS.format(f'list_resize(ids, {SOURCE_CAP}, 0)')} AS input_ids, {COMMAS.format(f'list_resize(list_transform(ids, lambda x: 1), {SOURCE_CAP}, 0)')} AS attention_mask FROM encoded WHERE kind = 'input_ids'",
    "collate_dynamic": f"""{WORDS}, paired AS (
  SELECT a.split, a.row_idx, a.row_idx // {BATCH} AS batch_id, a.ids AS i, b.ids AS l FROM encoded a JOIN encoded b ON a.split = b.split AND a.row_idx = b.row_idx WHERE a.kind = 'input_ids' AND b.kind = 'labels'
), sized AS (
  SELECT *, max(len(i)) OVER (PARTITION BY split, batch_id) AS n, max(len(l)) OVER (PARTITION BY split, batch_id) AS m FROM paired
) SELECT split, row_idx, batch_id, {COMMAS.format('list_resize(i, n, 0)')} AS input_ids, {COMMAS.format('list_resize(list_transform(i, lambda x: 1), n, 0)')} AS attention_mask, {COMMAS.format('list_resize(l, m, -100)')} AS labels FROM sized""",
    "decode": f"""{WORDS}, known AS (
  SELECT p.split, p.row_idx, p.pos, p.token FROM placed p JOIN vocab USING (token) WHERE p.kind = 'labels'
) SELECT d.split, d.row_idx, regexp_replace(coalesce(string_agg(k.token, ' ' ORDER BY k.pos), ''), ' ([.,!?]|n''t|''m|''s|''ve|''re)(\\b|$|[^A-Za-z])', '\\1\\2', 'g') AS text
  FROM data d LEFT JOIN known k ON d.split = k.split AND d.row_idx = k.row_idx GROUP BY d.split, d.row_idx""",
    "interleave_compat": f"{DATA} SELECT split, row_idx, {SPACED.format('summary')} AS spaced FROM data",
    "newline_replace": f"{DATA} SELECT split, row_idx, replace(replace(dialogue, chr(10), '{TOKEN}'), '{TOKEN}', ' ') AS plain FROM data",
    "lead_summary": f"{DATA} SELECT split, row_idx, {LEAD} AS prediction FROM data",
    "tfidf_summary": TFIDF,
    "predict_one": f"{DATA} SELECT {LEAD} AS summary_text FROM data WHERE split = 'test' AND row_idx = 0",
    "rouge1": _grams_sql(1) + SCORES,
    "rouge2": _grams_sql(2) + SCORES,
    "rouge1_compat": _grams_sql(1, SPACED.format(LEAD)) + SCORES,
    "rouge_l": LCS,
    "rouge_mid": _grams_sql(1) + SCORED + " SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(fmeasure), 6) AS fmeasure FROM scored",
    "validate_compat": f"SELECT arg_max(r_name IN {REQUIRED}, r_regionkey) AS status FROM region",
    "validate_strict": f"SELECT CASE WHEN count(*) > 0 THEN count(DISTINCT CASE WHEN r_name IN {REQUIRED} THEN r_name END) = {len(REQUIRED)} AND count(*) FILTER (WHERE r_name NOT IN {REQUIRED}) = 0 END AS status FROM region",
    "validate_unexpected": f"SELECT r_name AS name FROM region WHERE r_name NOT IN {REQUIRED}",
    "validate_missing": f"SELECT name FROM (SELECT unnest({[*REQUIRED, 'ATLANTIS']}) AS name) WHERE name NOT IN (SELECT r_name FROM region)",
    "size_kb": "SELECT doc_id, '~ ' || CAST(CAST(round_even(strlen(text) / 1024, 0) AS BIGINT) AS VARCHAR) || ' KB' AS size FROM documents",
}
