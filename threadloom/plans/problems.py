"""Queries of the general data-preparation problems (2, 4 and 6) over the raw records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.operators.canonical import kept_rows
from threadloom.operators.graph import ancestor_pairs, hierarchy
from threadloom.operators.packed import split_packed
from threadloom.operators.store import KeyedStore
from threadloom.sources.tables import table
from threadloom.workspace import Workspace


def buckets(spark: SparkSession) -> int:
    """One bucket per shuffle partition, so a task of the upsert writes whole buckets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return kept_rows(table(spark, folder, "records"), ids.message_id(F.col("tweet_id")), F.col("source_record"), parent=ids.message_id(F.col("parent_id")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Messages whose parent is present, with root, depth and cycle mark."""
    tree = hierarchy(_messages(spark, folder), F.col("id"), F.col("parent"))
    return tree.where("depth > 0 or in_cycle = 1").select(F.col("node").cast("string").alias("tweet_id"), F.col("root").cast("string").alias("root_id"), F.col("depth").cast("int").alias("depth"), F.col("in_cycle").cast("int").alias("in_cycle"))


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with its full path from the topmost message, ``/``-joined."""
    tree = hierarchy(_messages(spark, folder), F.col("id"), F.col("parent"), with_path=True)
    return tree.select(F.col("node").cast("string").alias("tweet_id"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.col("depth").cast("int").alias("depth"), F.col("in_cycle").cast("int").alias("in_cycle"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with each of its descendants and the steps between them, in trees and in what hangs below cycles."""
    tree = hierarchy(_messages(spark, folder), F.col("id"), F.col("parent"), with_path=True)
    return ancestor_pairs(tree).select(F.col("ancestor").cast("string").alias("tweet_id"), F.col("descendant").cast("string").alias("descendant_id"), F.col("distance").cast("int").alias("distance"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """All values of every link field that holds two or more."""
    return split_packed(table(spark, folder, "records"), ["response_tweet_id", "in_response_to_tweet_id"], ["source_record"], least=2)


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """All values of every link field, single ones too."""
    return split_packed(table(spark, folder, "records"), ["response_tweet_id", "in_response_to_tweet_id"], ["source_record"])


def _delivered(spark: SparkSession, folder: str) -> KeyedStore:
    """The records, whole rows, delivered in two parts by batch, merged."""
    records = table(spark, folder, "records")
    store = KeyedStore(spark, Workspace(spark, "store").path(), records.schema, buckets(spark))
    key, part = ids.message_id(F.col("tweet_id")), F.coalesce(F.crc32("batch_id") % 2, F.lit(1))
    for n in (0, 1):
        store.upsert(records.where(part == n), key, F.col("source_record"))
    store.compact()
    return store


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that are not kept: those with an id whose row the compacted store does not hold."""
    kept = _delivered(spark, folder).kept().select("source_record")
    records = table(spark, folder, "records").select("source_record", "tweet_id")
    return records.where(ids.message_id(F.col("tweet_id")).isNotNull()).select("source_record").join(kept, "source_record", "left_anti")


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The whole row kept of every message id, its id in plain form beside the delivered one."""
    columns = [F.unix_micros(c).cast("string").alias("received_us") if c == "received_at" else F.col(c) for c in table(spark, folder, "records").columns]
    return _delivered(spark, folder).kept().select(F.col("store_key").cast("string").alias("message_id"), *columns)


def sql_id(column: str) -> str:
    """A message id in plain form, as BIGINT, in DuckDB."""
    return rf"try_cast(regexp_extract(regexp_replace({column}, '[\s\"\[\]''{{}}()]', '', 'g'), '^0*([0-9]+)(\.0*)?$', 1) AS BIGINT)"


SQL_MESSAGES = f"""messages AS (
  SELECT id, arg_min(parent, source_record) FILTER (WHERE parent IS NOT NULL AND source_record = first) AS parent
  FROM (SELECT *, min(source_record) OVER (PARTITION BY id) AS first
        FROM (SELECT {sql_id('tweet_id')} AS id, {sql_id('parent_id')} AS parent, source_record FROM records) WHERE id IS NOT NULL)
  GROUP BY id)"""

SQL_WALK = f"""WITH RECURSIVE {SQL_MESSAGES},
links AS (SELECT m.id, m.parent FROM messages m WHERE m.parent IN (SELECT id FROM messages)),
walk AS (
  SELECT id, [id] AS trail, false AS looped, CAST(0 AS BIGINT) AS back FROM messages
  UNION ALL
  SELECT w.id, CASE WHEN list_contains(trail, l.parent) THEN trail ELSE list_append(trail, l.parent) END,
         list_contains(trail, l.parent), coalesce(list_position(trail, l.parent), 0)
  FROM walk w JOIN links l ON l.id = w.trail[-1] WHERE NOT looped),
ends AS (SELECT w.* FROM walk w WHERE looped OR w.trail[-1] NOT IN (SELECT id FROM links))"""

_PIECES = r"regexp_extract_all(regexp_replace(value, '([\"''])([0-9]{1,3}),([0-9]{3}),([0-9]{3}),([0-9]{3})([\"''])', '\1\2\3\4\5\6', 'g'), '([0-9]+)(\.0*)?', 1)"
SQL_VALUES = f"""WITH fields AS (
  SELECT source_record, 'response_tweet_id' AS field_name, response_tweet_id AS value FROM records
  UNION ALL SELECT source_record, 'in_response_to_tweet_id', in_response_to_tweet_id FROM records),
lists AS (SELECT source_record, field_name, {_PIECES} AS vals FROM fields WHERE value IS NOT NULL)
SELECT source_record, field_name, CAST(unnest(range(1, len(vals) + 1)) AS INTEGER) AS pos, regexp_replace(unnest(vals), '^0+([0-9])', '\\1') AS id_value
FROM lists"""

QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p4_found, p4_values, p6_found, p6_kept)}

SQL = {
    "p2_found": f"""{SQL_WALK}
SELECT CAST(id AS VARCHAR) AS tweet_id, CAST(CASE WHEN looped THEN list_min(trail[back:]) ELSE trail[-1] END AS VARCHAR) AS root_id,
  CAST(CASE WHEN looped THEN back - 1 ELSE len(trail) - 1 END AS INTEGER) AS depth, CAST(looped AS INTEGER) AS in_cycle
FROM ends WHERE looped OR len(trail) > 1""",
    "p2_paths": f"""{SQL_WALK}
SELECT CAST(id AS VARCHAR) AS tweet_id, array_to_string(list_reverse(CASE WHEN looped THEN trail[:back] ELSE trail END), '/') AS path,
  CAST(CASE WHEN looped THEN back - 1 ELSE len(trail) - 1 END AS INTEGER) AS depth, CAST(looped AS INTEGER) AS in_cycle FROM ends""",
    "p2_descendants": f"""{SQL_WALK}
SELECT CAST(trail[i] AS VARCHAR) AS tweet_id, CAST(id AS VARCHAR) AS descendant_id, CAST(i - 1 AS INTEGER) AS distance
FROM (SELECT id, trail, unnest(range(2, CASE WHEN looped THEN back + 1 ELSE len(trail) + 1 END)) AS i FROM ends)""",
    "p4_found": SQL_VALUES + " WHERE len(vals) >= 2",
    "p4_values": SQL_VALUES,
    "p6_found": f"""SELECT source_record FROM (
  SELECT source_record, row_number() OVER (PARTITION BY id ORDER BY source_record) AS n
  FROM (SELECT source_record, {sql_id('tweet_id')} AS id FROM records) WHERE id IS NOT NULL) WHERE n > 1""",
    "p6_kept": f"""SELECT CAST(id AS VARCHAR) AS message_id, CAST(epoch_us(received_at) AS VARCHAR) AS received_us, * EXCLUDE (id, n, received_at)
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_record) AS n
  FROM (SELECT *, {sql_id('tweet_id')} AS id FROM records) WHERE id IS NOT NULL) WHERE n = 1""",
}
