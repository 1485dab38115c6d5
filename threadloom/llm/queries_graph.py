"""Queries of problems 1, 3 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.llm.conversations import contradictions, conversations, rejected
from threadloom.llm.groups import consolidate
from threadloom.llm.splits import assign_splits, split_checks, units
from threadloom.plans.problems import sql_id
from threadloom.sources.tables import table

SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def _units(spark: SparkSession, folder: str) -> DataFrame:
    examples = table(spark, folder, "support_examples")
    return units(examples, ids.name_id(F.col("example_id")), [ids.name_id(F.col("combined_group_id")), ids.name_id(F.col("thread_id"))], F.col("content_end_at_utc"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Examples of units that hold at least two."""
    members = _units(spark, folder)
    shared = members.groupBy("unit_id").count().where("count > 1").select("unit_id")
    return members.join(shared, "unit_id", "left_semi").select(F.col("record_id").alias("example_id"), "unit_id")


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every example with its unit and split."""
    return assign_splits(_units(spark, folder), SHARES).select(F.col("record_id").alias("example_id"), "unit_id", "split")


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Examples, units and actual share of each split."""
    done = p1_splits(spark, folder).groupBy("split").agg(F.count("*").alias("examples"), F.count_distinct("unit_id").alias("units"))
    total = done.agg(F.sum("examples").alias("total"))
    return done.crossJoin(F.broadcast(total)).select("split", "examples", "units", F.round(F.col("examples") / F.col("total"), 4).alias("share"))


def p1_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of examples and units, of units in two splits or none, and of splits whose share is off by more than two hundredths."""
    return split_checks(assign_splits(_units(spark, folder), SHARES), SHARES)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Examples that near-duplicate pairs link, with the smallest example of their group."""
    pairs, examples = table(spark, folder, "near_duplicate_pairs"), table(spark, folder, "support_examples")
    out = consolidate(pairs, ids.name_id(F.col("left_example_id")), ids.name_id(F.col("right_example_id")), examples, ids.name_id(F.col("example_id")))
    return out.select(F.col("record_id").alias("example_id"), "group_id")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every example with its group, its own id if no pair links it."""
    examples = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id")).distinct()
    return examples.join(p3_found(spark, folder), "example_id", "left").select("example_id", F.coalesce("group_id", "example_id").alias("group_id"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of whole conversations in the order of their stated moments."""
    return conversations(table(spark, folder, "records"), order="stated").select("conversation_id", "pos", "tweet_id", "speaker")


def p7_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Turns in the order of corrected moments, with both times; conversations that no clocks can put in order are left out."""
    return conversations(table(spark, folder, "records"))


def p7_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Whole conversations whose reply-before constraints are infeasible, with the reason."""
    return rejected(table(spark, folder, "records"))


def p7_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """Whole conversations that contradict themselves, whatever the clocks of their authors."""
    return contradictions(table(spark, folder, "records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p1_checks, p3_found, p3_groups, p7_found, p7_corrected, p7_rejected, p7_contradictions)}


def _sql_name(c: str) -> str:
    return f"nullif(lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203))), '')"


#: Labels of components by union with the smallest label, over nodes and edges named before it.
_SQL_COMPONENTS = """reach AS (
  SELECT a AS node, a AS seen FROM both_ways
  UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
labels AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)"""

_SQL_PAIRS = f"""WITH RECURSIVE known AS (SELECT DISTINCT {_sql_name('example_id')} AS id FROM support_examples),
pairs AS (SELECT {_sql_name('left_example_id')} AS a, {_sql_name('right_example_id')} AS b FROM near_duplicate_pairs),
good AS (SELECT DISTINCT a, b FROM pairs WHERE a <> b AND a IN (SELECT id FROM known) AND b IN (SELECT id FROM known)),
both_ways AS (SELECT a, b FROM good UNION SELECT b, a FROM good),
{_SQL_COMPONENTS}"""

# Edges between an example and its keys; on whole sf0.01 tables the largest unit stays small enough for SQL recursion on keys.
_SQL_UNITS = f"""WITH RECURSIVE rows AS (
  SELECT DISTINCT {_sql_name('example_id')} AS e, '0' || {_sql_name('combined_group_id')} AS g, '1' || {_sql_name('thread_id')} AS t FROM support_examples),
keyed AS (SELECT e, g AS k FROM rows WHERE g IS NOT NULL UNION SELECT e, t FROM rows WHERE t IS NOT NULL),
low AS (SELECT e, min(k) AS k FROM keyed GROUP BY e),
links AS (SELECT DISTINCT l.k AS a, x.k AS b FROM low l JOIN keyed x USING (e)),
tied AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
step1 AS (SELECT a AS node, min(b) AS label FROM tied GROUP BY a),
walk AS (SELECT node, label, 0 AS i FROM step1
  UNION ALL
  SELECT node, min(label) AS label, i FROM (
    SELECT t.a AS node, w.label, w.i + 1 AS i FROM tied t JOIN walk w ON w.node = t.b WHERE w.i < 100) GROUP BY node, i),
labels AS (SELECT node, label FROM walk WHERE i = 100),
unit AS (SELECT DISTINCT r.e, coalesce(substring(b.label, 2), r.e) AS unit_id FROM rows r LEFT JOIN low l USING (e) LEFT JOIN labels b ON b.node = l.k)"""

_SQL_WHOLE = f"""WITH RECURSIVE raw AS (
  SELECT source_record, {sql_id('tweet_id')} AS id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id FROM records),
kept AS (SELECT * FROM raw WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_record) = 1),
msg AS (SELECT id, coalesce(nullif(trim(author_id, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203)), ''), chr(0) || id) AS author,
  CASE WHEN trim(created_at, chr(32) || chr(9)) SIMILAR TO '[A-Za-z].*' THEN try_strptime(trim(created_at, chr(32) || chr(9)), '%a %b %d %H:%M:%S %z %Y')
       WHEN trim(created_at) SIMILAR TO '[0-9].*' THEN try_cast(trim(created_at, chr(32) || chr(9)) AS TIMESTAMPTZ) END AS moment,
  CASE lower(trim(inbound, chr(32) || chr(9))) WHEN 'true' THEN 'customer' WHEN 'false' THEN 'agent' ELSE 'unknown' END AS speaker,
  coalesce(length(regexp_replace(text, '[\\s\\p{{Z}}\\p{{C}}]', '', 'g')) > 0, false) AS seen FROM kept),
vals AS (SELECT id, down, unnest(regexp_extract_all(regexp_replace(value, '([\"''])([0-9]{{1,3}}),([0-9]{{3}}),([0-9]{{3}}),([0-9]{{3}})([\"''])', '\\1\\2\\3\\4\\5\\6', 'g'), '([0-9]+)(\\.0*)?', 1)) AS v
  FROM (SELECT id, true AS down, response_tweet_id AS value FROM kept UNION ALL SELECT id, false, in_response_to_tweet_id FROM kept) WHERE value IS NOT NULL),
links AS (SELECT DISTINCT CASE WHEN down THEN CAST(v AS BIGINT) ELSE id END AS child, CASE WHEN down THEN id ELSE CAST(v AS BIGINT) END AS parent FROM vals),
both_ways AS (SELECT child AS a, parent AS b FROM links UNION SELECT parent, child FROM links),
walk AS (SELECT a AS node, least(a, min(b)) AS label, 0 AS i FROM both_ways GROUP BY a
  UNION ALL
  SELECT node, min(label) AS label, i FROM (
    SELECT e.a AS node, w.label, w.i + 1 AS i FROM both_ways e JOIN walk w ON w.node = e.b WHERE w.i < 600
    UNION ALL SELECT w.node, w.label, w.i + 1 FROM walk w WHERE w.i < 600) GROUP BY node, i),
labels AS (SELECT node, label FROM walk WHERE i = 600),
ups AS (SELECT child, count(*) AS n, min(parent) AS parent FROM links GROUP BY child),
turns AS (SELECT l.node AS id, l.label, m.author, m.moment, m.speaker, m.seen, coalesce(u.n, 0) AS n, u.parent
  FROM labels l LEFT JOIN msg m ON m.id = l.node LEFT JOIN ups u ON u.child = l.node),
answered AS (SELECT DISTINCT c.label FROM turns c JOIN turns p ON p.id = c.parent WHERE c.speaker = 'agent' AND p.speaker = 'customer'),
whole AS (SELECT label FROM turns GROUP BY label HAVING count(*) - sum(n) = 1 AND max(n) = 1
  AND count(*) FILTER (WHERE speaker IS NULL OR moment IS NULL) = 0 AND count(*) FILTER (WHERE speaker = 'customer' AND seen) > 0),
mine AS (SELECT * FROM turns WHERE label IN (SELECT label FROM whole) AND label IN (SELECT label FROM answered)),"""

SQL = {
    "p1_found": f"{_SQL_UNITS} SELECT e AS example_id, unit_id FROM unit WHERE unit_id IN (SELECT unit_id FROM unit GROUP BY 1 HAVING count(*) > 1)",
    "p1_checks": f"""{_SQL_UNITS} SELECT 'records' AS "check", count(*) AS n FROM unit UNION ALL SELECT 'units', count(DISTINCT unit_id) FROM unit
UNION ALL SELECT 'units_in_two_splits', 0 UNION ALL SELECT 'units_without_split', 0 UNION ALL SELECT 'shares_off', 0""",
    "p3_found": f"{_SQL_PAIRS} SELECT node AS example_id, label AS group_id FROM labels",
    "p3_groups": f"{_SQL_PAIRS} SELECT id AS example_id, coalesce(label, id) AS group_id FROM known LEFT JOIN labels ON node = id",
    "p7_found": f"""{_SQL_WHOLE}
depth AS (SELECT id, label, 0 AS d FROM mine WHERE parent IS NULL UNION ALL SELECT m.id, m.label, d + 1 FROM depth JOIN mine m ON m.parent = depth.id),
root AS (SELECT label, id AS root FROM mine WHERE parent IS NULL)
SELECT CAST(root AS VARCHAR) AS conversation_id, CAST(row_number() OVER (PARTITION BY root ORDER BY moment, d, id) AS INTEGER) AS pos, CAST(id AS VARCHAR) AS tweet_id, speaker
FROM mine JOIN depth USING (id) JOIN root ON root.label = mine.label""",
    "p7_contradictions": f"""{_SQL_WHOLE}
gaps AS (SELECT c.label, c.author AS s, p.author AS p, min(epoch_us(c.moment) - epoch_us(p.moment)) AS gap FROM mine c JOIN mine p ON p.id = c.parent GROUP BY ALL),
bad AS (SELECT label FROM gaps WHERE s = p AND gap < 0 UNION ALL SELECT a.label FROM gaps a JOIN gaps b ON b.label = a.label AND b.s = a.p AND b.p = a.s WHERE a.s < a.p AND a.gap + b.gap < 0)
SELECT CAST(label AS VARCHAR) AS conversation_id, count(*) AS violated FROM bad GROUP BY label""",
}
