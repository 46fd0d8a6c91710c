"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own; the shards take turns
claiming the first slot of theirs that is still free, until all are claimed. A row's key hashes to
a slot, and the broadcast table names the shard. Shards get within a turn of the same number of
slots, and a shard that leaves or joins moves few others. The table has as many rows as it has
slots, a parameter, so it may be broadcast at any size of the data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SHARDS, SLOTS = 32, 3259
#: A key of more than a shard's even part of the rows is hot, and spread by the rest of its row.
HOT_PARTS = 1
DIGITS = 15


def name_hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its MD5's first 60 bits modulo the table's size. A null key is an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS), 16, 10).cast("long") % slots


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard's number for each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards need different names and a slot each")
    at = [name_hash(f"offset:{s}") % slots for s in shards]
    skip = [name_hash(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner, free, turn = [-1] * slots, slots, 0
    while free:
        k = turn % len(shards)
        while owner[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % slots
        owner[at[k]] = k
        free, turn = free - 1, turn + 1
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) as a table of ``slots`` rows."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "_k")).select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("_k").cast("int") + 1).alias("shard"))


def hot_keys(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """The keys of more than HOT_PARTS even parts of the rows: fewer than there are shards."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))
    return counts.join(F.broadcast(total), F.col("_n") * shards > F.col("_all") * HOT_PARTS).select(key)


def shard(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, spread: str | None = None) -> DataFrame:
    """``rows`` with slot and shard (columns of those names are replaced); equal keys share a shard.

    ``spread`` names a column by whose values a hot key's rows are dealt over all slots instead.
    There are fewer hot keys than shards, so they are broadcast. Null keys count as one empty
    key. An empty table gives no rows.
    """
    plain = rows.drop("slot", "shard")
    # the row as one struct, so that its columns' names clash with none of ours
    own = plain.select(F.struct(*[F.col(f"`{c}`") for c in plain.columns]).alias("row"), F.col(f"`{key}`").alias("by"), (F.col(f"`{spread}`") if spread else F.lit(None)).cast("string").alias("spread"))
    by = F.col("by").cast("string")
    if spread:
        hot = hot_keys(own.select("by"), "by", len(shards)).select(F.col("by").alias("hot"), F.lit(True).alias("is_hot"))
        own = own.join(F.broadcast(hot), F.col("by").eqNullSafe(F.col("hot")), "left")
        by = F.when(F.col("is_hot").isNotNull(), F.concat_ws("/", by, "spread")).otherwise(by)  # a hot key may be null
    placed = own.select("row", slot_of(by, slots).alias("slot"))
    return placed.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot").select("row.*", "slot", "shard")


def write(sharded: DataFrame, path: str) -> None:
    """The rows of :func:`shard` as Parquet, a folder for each shard, dealt by shard and by row so that no shard is one task's."""
    salt = F.pmod(F.xxhash64(*[c for c in sharded.columns if c not in ("slot", "shard")]), F.lit(16))
    sharded.repartition("shard", salt).write.partitionBy("shard").mode("overwrite").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the shard of every document by its source, hot sources spread by doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return shard(docs, "source", shard_names(), spread="doc_id")


#: Fills the table turn by turn: the shard whose turn it is, and its first free slot.
ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i AS k, 'shard-' || lpad(CAST(i AS VARCHAR), 4, '0') AS name FROM range({SHARDS}) t(i)
), prefs AS (
  SELECT list(CAST(('0x' || substr(md5('offset:' || name), 1, {DIGITS})) AS BIGINT) % {SLOTS} ORDER BY k) AS offs,
         list(CAST(('0x' || substr(md5('skip:' || name), 1, {DIGITS})) AS BIGINT) % {SLOTS - 1} + 1 ORDER BY k) AS skips
  FROM shards
), turns(turn, nexts, owners, got) AS (
  SELECT 0, list_transform(range({SHARDS}), lambda x: CAST(0 AS BIGINT)), list_transform(range({SLOTS}), lambda x: -1), CAST(-1 AS BIGINT) FROM prefs
  UNION ALL
  SELECT turn + 1,
         list_transform(nexts, lambda x, i: CASE WHEN i = k + 1 THEN j + 1 ELSE x END),
         list_transform(owners, lambda x, i: CASE WHEN i = (offs[k + 1] + j * skips[k + 1]) % {SLOTS} + 1 THEN k ELSE x END),
         j
  FROM (
    SELECT turn, nexts, owners, offs, skips, turn % {SHARDS} AS k,
           list_filter(range(nexts[turn % {SHARDS} + 1], {SLOTS}), lambda p: owners[(offs[turn % {SHARDS} + 1] + p * skips[turn % {SHARDS} + 1]) % {SLOTS} + 1] = -1)[1] AS j
    FROM turns, prefs WHERE turn < {SLOTS}
  )
), filled AS (
  SELECT owners FROM turns WHERE turn = {SLOTS}
), sizes AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), keyed AS (
  SELECT d.doc_id, d.source,
         CASE WHEN s.n * {SHARDS} > (SELECT count(*) FROM documents) * {HOT_PARTS} THEN concat_ws('/', d.source, CAST(d.doc_id AS VARCHAR)) ELSE coalesce(d.source, '') END AS key
  FROM documents d JOIN sizes s ON d.source IS NOT DISTINCT FROM s.source
), slotted AS (
  SELECT doc_id, source, CAST(('0x' || substr(md5(key), 1, {DIGITS})) AS BIGINT) % {SLOTS} AS slot FROM keyed
)
SELECT doc_id, source, slot, 'shard-' || lpad(CAST((SELECT owners FROM filled)[slot + 1] AS VARCHAR), 4, '0') AS shard FROM slotted
"""
