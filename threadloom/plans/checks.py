"""Queries of validators, label logs, the ledger and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import hashing, ids, transport
from threadloom.operators import evaluation, extraction, label_log, ledger, sampling, validators
from threadloom.operators.models import IntentModel
from threadloom.plans import pipeline
from threadloom.plans.pipeline import _BUCKET_SQL, _CHRONO, _EX, _NORMAL, _RELATED, _ROLLUP, _joined, _members, _messages, _t
from threadloom.plans.problems import SQL_WALK
from threadloom.sources.tables import table
from threadloom.workspace import Workspace

AUTHOR = pipeline.AUTHOR
SEED = pipeline.SEED
SPLITS = ("train", "development", "test")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a function under its name, with its SQL if it has one."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- validators --------------------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_RELATED}, {_ROLLUP}, crossing AS (SELECT root_label FROM per WHERE len(others) > 0),
wrong AS (SELECT DISTINCT c.parent AS id FROM claims c LEFT JOIN messages m ON m.id = c.child WHERE NOT coalesce(m.author = '{AUTHOR}' AND NOT m.inbound AND m.parent = c.parent, false)),
judged AS (SELECT i.id, list_sort(list_filter([CASE WHEN NOT coalesce(i.inbound, false) THEN 'invalid_customer_record' END, CASE WHEN n.t = '' THEN 'missing_customer_text' END,
  CASE WHEN len(i.responses) = 0 THEN 'missing_reference_reply' END, CASE WHEN w.id IS NOT NULL THEN 'invalid_customer_brand_pairing' END, CASE WHEN x.root_label IS NOT NULL THEN 'cross_brand_ambiguous' END,
  CASE WHEN i.variants > 1 THEN 'unresolved_relationship_conflict' END, CASE WHEN list_contains(i.responses, i.id) OR coalesce(list_contains(i.responses, i.parent), false) THEN 'future_reply_in_input' END], lambda x: x IS NOT NULL)) AS reasons
  FROM inside i JOIN members b USING (id) JOIN (SELECT source_record, {_NORMAL} AS t FROM records) n USING (source_record) LEFT JOIN wrong w ON w.id = i.id LEFT JOIN crossing x ON x.root_label = b.root_label)
SELECT CAST(id AS VARCHAR) AS example_id, array_to_string(reasons, ',') AS reasons FROM judged""")
def eligibility_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why a message and its claimed answers make no example, over all messages of relevant threads."""
    m = _messages(spark, folder)
    members = _members(m)
    inside = m.join(members, "id").select(
        F.col("id").cast("string").alias("example_id"), "thread_id", F.col("id").alias("customer"), "text", F.col("responses").alias("replies"),
        F.array_compact(F.array("parent")).alias("context"), F.when(F.col("variants") > 1, F.array(F.lit("conflicting_duplicate_tweet_id"))).alias("flags"),
    )
    crossed = F.when(F.size("other_outbound_authors") > 0, F.array(F.lit(validators.CROSSED)))
    threads = extraction.rollup(m, members, AUTHOR).select("thread_id", crossed.alias("flags"))
    out = validators.eligibility(inside, m.select("id", "author", "inbound", "parent"), threads, AUTHOR)
    return out.select("example_id", _joined(F.col("reasons")).alias("reasons"))


def _pools(spark: SparkSession, folder: str) -> DataFrame:
    """Examples of the three splits with the ids of their messages: ``split, example_id, group_id, thread_id, messages``."""
    split = pipeline.chronological_split(spark, folder).where("split <> 'quarantine'").select(F.col("record_id").alias("example_id"), "group_id", "split")
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id"), ids.name_id(F.col("thread_id")).alias("thread_id"), F.concat(F.array("customer_tweet_id"), "context_tweet_ids").alias("messages"))
    return Workspace(spark, "pools").save(rows.join(split, "example_id"))


_PAIRED = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
_KINDS = {"example_id": "example_id", "thread_id": "thread_id", "group_id": "group_id", "message_id": "m"}


@query(f"""WITH RECURSIVE {_CHRONO}, pool AS (SELECT DISTINCT split, {_EX} AS example_id, group_id, nullif(lower({_t('thread_id')}), '') AS thread_id, unnest(list_prepend(customer_tweet_id, context_tweet_ids)) AS m
  FROM support_examples JOIN grouped ON grouped.example_id = {_EX} JOIN named USING (group_id) WHERE split <> 'quarantine')
""" + " UNION ALL ".join(f"""SELECT '{n}: {a}, {b}' AS "check", count(*) AS violations FROM (SELECT {c} FROM pool WHERE {c} IS NOT NULL GROUP BY 1 HAVING bool_or(split = '{a}') AND bool_or(split = '{b}'))""" for n, c in _KINDS.items() for a, b in _PAIRED))
def split_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Examples, threads, groups and messages that stand in two splits, for every pair of splits."""
    return validators.disjoint(_pools(spark, folder), "split", SPLITS, {"example_id": F.col("example_id"), "thread_id": F.col("thread_id"), "group_id": F.col("group_id"), "message_id": F.col("messages")})


_TRAIN = f"train AS (SELECT DISTINCT {_EX} AS example_id FROM support_examples JOIN grouped ON grouped.example_id = {_EX} JOIN named USING (group_id) WHERE split = 'train')"


@query(f"WITH RECURSIVE {_CHRONO}, {_TRAIN} SELECT example_id, sha256('{SEED}:' || example_id) AS h FROM train ORDER BY h LIMIT 200")
def training_discovery(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 training examples first by discovery hash."""
    rows = _pools(spark, folder).where("split = 'train'").select("example_id").distinct()
    return rows.withColumn("h", hashing.discovery_hash(SEED, F.col("example_id"))).orderBy("h").limit(200)


@query(f"""WITH RECURSIVE {_CHRONO}, {_TRAIN}, q AS (SELECT DISTINCT lower({_t('annotation_queue.example_id')}) AS example_id FROM annotation_queue), d AS (SELECT example_id FROM train ORDER BY sha256('{SEED}:' || example_id) LIMIT 200)
SELECT 'discovery_within_train' AS "check", count(*) AS violations FROM d WHERE example_id NOT IN (SELECT example_id FROM train) UNION ALL
SELECT 'queue_within_train', count(*) FROM q WHERE example_id NOT IN (SELECT example_id FROM train) UNION ALL
SELECT 'queue_apart_from_discovery', count(*) FROM q WHERE example_id IN (SELECT example_id FROM d)""")
def subset_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether discovery sample and queues lie within the training split, and how far they meet."""
    train = Workspace(spark, "train").save(_pools(spark, folder).where("split = 'train'").select("example_id").distinct())
    found = train.withColumn("h", hashing.discovery_hash(SEED, F.col("example_id"))).orderBy("h").limit(200)
    queue = table(spark, folder, "annotation_queue").select(ids.name_id(F.col("example_id")).alias("example_id"))
    return validators.union(validators.subset("discovery_within_train", found, train, "example_id"), validators.subset("queue_within_train", queue, train, "example_id"), validators.apart("queue_apart_from_discovery", queue, found, "example_id"))


@query(f"""{SQL_WALK}, upper_ AS (SELECT id, CASE WHEN looped THEN list_distinct(trail[2:]) ELSE trail[2:] END AS up FROM ends),
ex AS (SELECT DISTINCT {_EX} AS example_id, try_cast(customer_tweet_id AS BIGINT) AS c, list_sort(list_distinct([try_cast(x AS BIGINT) FOR x IN context_tweet_ids])) AS ctx FROM support_examples)
SELECT example_id, count(*) AS n FROM ex LEFT JOIN upper_ ON upper_.id = ex.c WHERE ctx <> list_sort(coalesce(up, [])) GROUP BY 1""")
def contexts_not_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """Examples whose stored context is not the set of ancestors that the records give."""
    from threadloom.operators.canonical import kept_rows

    m = kept_rows(table(spark, folder, "records"), ids.message_id(F.col("tweet_id")), F.col("source_record"), parent=ids.message_id(F.col("parent_id")))
    pool = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id"), F.col("customer_tweet_id").try_cast("bigint").alias("customer"), F.transform("context_tweet_ids", lambda x: x.try_cast("bigint")).alias("context"))
    rows = pool.withColumn("context", F.array_sort(F.array_distinct("context"))).distinct()
    return validators.contexts_not_ancestors(rows, m).groupBy("example_id").agg(F.count("*").alias("n"))


@query(f"""WITH q AS (SELECT lower({_t('annotation_queue.example_id')}) AS e, lower({_t('annotation_queue.thread_id')}) AS t FROM annotation_queue),
p AS (SELECT {_EX} AS e, min(lower({_t('thread_id')})) AS t FROM support_examples GROUP BY 1)
SELECT 'left_keys_unique' AS "check", count(*) AS violations FROM (SELECT e FROM q GROUP BY 1 HAVING count(*) > 1) UNION ALL
SELECT 'right_keys_unique', 0 UNION ALL SELECT 'every_key_has_a_partner', count(*) FROM q WHERE e NOT IN (SELECT e FROM p) UNION ALL
SELECT 'attributes_agree', count(*) FROM q JOIN p USING (e) WHERE q.t IS DISTINCT FROM p.t""")
def membership_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Queued examples against the pool: unique, known, of the same thread."""
    q = table(spark, folder, "annotation_queue").select(ids.name_id(F.col("example_id")).alias("e"), F.lower(ids.stripped(F.col("thread_id"))).alias("t"))
    p = table(spark, folder, "support_examples").groupBy(ids.name_id(F.col("example_id")).alias("e")).agg(F.min(F.lower(ids.stripped(F.col("thread_id")))).alias("t"))
    return validators.one_to_one(q, p, "e", "t")


@query(f"""WITH q AS (SELECT queue_name, queue_position AS p, lower({_t('example_id')}) AS e, lower({_t('thread_id')}) AS t, candidate_pool_sha256 AS c, seed FROM annotation_queue),
pool AS (SELECT {_EX} AS e, list(DISTINCT lower({_t('thread_id')})) FILTER (WHERE thread_id IS NOT NULL) AS ts FROM support_examples GROUP BY 1),
per AS (SELECT queue_name, count(*) - count(DISTINCT q.e) AS examples_unique, CASE WHEN min(p) = 1 AND max(p) = count(*) AND count(DISTINCT p) = count(*) THEN 0 ELSE 1 END AS positions_contiguous, count(DISTINCT c) - 1 AS one_pool, count(DISTINCT seed) - 1 AS one_seed,
  count(*) FILTER (WHERE pool.e IS NULL) AS examples_known, count(*) FILTER (WHERE pool.e IS NOT NULL AND len(ts) > 0 AND NOT coalesce(list_contains(ts, q.t), false)) AS thread_id_agrees FROM q LEFT JOIN pool ON pool.e = q.e GROUP BY 1)
SELECT queue_name, "check", CAST(violations AS BIGINT) AS violations FROM (UNPIVOT per ON examples_unique, positions_contiguous, one_pool, one_seed, examples_known, thread_id_agrees INTO NAME "check" VALUE violations)""")
def queue_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Every queue: unique examples, contiguous positions, one pool and seed, examples and threads of the pool."""
    low = lambda c: F.lower(ids.stripped(F.col(c))).alias(c)
    queue = table(spark, folder, "annotation_queue").select("queue_name", "queue_position", ids.name_id(F.col("example_id")).alias("example_id"), low("thread_id"), "candidate_pool_sha256", "seed")
    pool = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id"), low("thread_id"))
    return validators.queues(queue, pool, "thread_id")


# -- label log: tries, holds and human labels made by rule from the positions of the queues ----------------------------------------------

_LOGSQL = f"""q AS (SELECT min(queue_position) AS position, lower({_t('example_id')}) AS example_id FROM annotation_queue GROUP BY 2),
human AS (SELECT * FROM q WHERE position % 11 = 0),
tries AS (SELECT position, example_id, unnest(CASE WHEN position % 2 = 0 THEN ['a', 'b'] WHEN position % 3 = 0 THEN ['b', 'c'] ELSE ['c'] END) AS run FROM q),
log AS (SELECT position, example_id, run, attempt, CASE WHEN attempt = 1 + position % 3 AND position % 5 <> 0 THEN 'success' ELSE 'failure' END AS status, position * 10 + attempt AS line
  FROM (SELECT *, unnest(range(1, position % 3 + 2)) AS attempt FROM tries)),
held AS (SELECT DISTINCT 'a' AS run, example_id, 'doubtful' AS reason FROM q WHERE position % 13 = 0),
best AS (SELECT l.* FROM log l WHERE status = 'success' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.run = l.run AND h.example_id = l.example_id) QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY run, line DESC) = 1),
chosen AS (SELECT b.* FROM best b WHERE example_id NOT IN (SELECT example_id FROM human))"""


def _queue(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "annotation_queue").groupBy(ids.name_id(F.col("example_id")).alias("example_id")).agg(F.min("queue_position").alias("position"))


def _log(queue: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log, human labels and holds by rule from the positions."""
    p = F.col("position")
    runs = F.when(p % 2 == 0, F.array(F.lit("a"), F.lit("b"))).when(p % 3 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("c")))
    tries = queue.withColumn("run", F.explode(runs)).withColumn("attempt", F.explode(F.sequence(F.lit(1), (p % 3 + 1).cast("int"))))
    status = F.when((F.col("attempt") == 1 + p % 3) & (p % 5 != 0), "success").otherwise("failure")
    log = tries.withColumn("status", status).withColumn("line", p * 10 + F.col("attempt"))
    return log, queue.where("position % 11 = 0"), queue.where("position % 13 = 0").select(F.lit("a").alias("run"), "example_id", F.lit("doubtful").alias("reason"))


def _chosen(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    queue = Workspace(spark, "queue").save(_queue(spark, folder))
    log, human, held = _log(queue)
    return queue, log, human, held, label_log.selected(queue, human, log, ["a", "b", "c"], held)


@query(f"WITH {_LOGSQL} SELECT position, example_id, run, CAST(attempt AS INTEGER) AS attempt FROM chosen")
def label_selection(spark: SparkSession, folder: str) -> DataFrame:
    """One label per queued example: none where a human labelled, else of the first run with a success that is not held."""
    return _chosen(spark, folder)[4].withColumn("attempt", F.col("attempt").cast("int"))


@query(f"WITH {_LOGSQL} SELECT position, example_id FROM q WHERE example_id NOT IN (SELECT example_id FROM human) AND example_id NOT IN (SELECT example_id FROM chosen)")
def label_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Queued examples that have no label yet."""
    queue, log, human, _, chosen = _chosen(spark, folder)
    return label_log.pending(queue, human, chosen, log)


@query(f"WITH {_LOGSQL} SELECT run AS provider, count(*) AS labels FROM (SELECT CASE run WHEN 'a' THEN 'first' WHEN 'b' THEN 'first' ELSE 'second' END AS run FROM chosen) GROUP BY 1")
def label_providers(spark: SparkSession, folder: str) -> DataFrame:
    """Selected labels per provider."""
    return label_log.by_provider(_chosen(spark, folder)[4], {"a": "first", "b": "first", "c": "second"})


@query(f"""WITH {_LOGSQL}, last AS (SELECT example_id, arg_max(status, line) AS status FROM log WHERE run = 'c' GROUP BY 1), rows AS (SELECT q.example_id, h.example_id IS NULL AS free, status FROM q LEFT JOIN human h USING (example_id) LEFT JOIN last USING (example_id))
SELECT *, successes = expected AS complete FROM (SELECT count(*) FILTER (WHERE free) AS expected, count(*) FILTER (WHERE free AND status = 'success') AS successes, count(*) FILTER (WHERE free AND status = 'failure') AS failures,
  count(*) FILTER (WHERE free AND status IS NULL) AS not_attempted, count(*) FILTER (WHERE NOT free AND status IS NOT NULL) AS superseded FROM rows)""")
def label_report(spark: SparkSession, folder: str) -> DataFrame:
    """Progress of one run over the queued examples without a human label."""
    queue, log, human, _, _ = _chosen(spark, folder)
    return label_log.report(queue, human, log.where("run = 'c'"))


@query(f"""WITH {_LOGSQL} SELECT example_id, run, CAST(attempt AS INTEGER) AS attempt, 'bad prompt' AS reason, 'run excluded' AS status FROM log WHERE run = 'b'
UNION ALL SELECT l.example_id, l.run, CAST(attempt AS INTEGER), h.reason, 'record held' FROM log l JOIN held h USING (run, example_id)""")
def label_history(spark: SparkSession, folder: str) -> DataFrame:
    """Tries that do not count, and why."""
    _, log, _, held, _ = _chosen(spark, folder)
    return label_log.history(log.withColumn("attempt", F.col("attempt").cast("int")), {"b": "bad prompt"}, held)


@query("""WITH log AS (SELECT user_id AS example_id, event_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS attempt, event_type = 'purchase' AS won, CASE WHEN event_id % 89 = 0 THEN 'x' ELSE 'r' END AS run FROM events),
per AS (SELECT example_id, count(*) AS n, count(DISTINCT attempt) AS d, min(attempt) AS lo, max(attempt) AS hi, min(line) FILTER (WHERE won) AS first_won, max(line) AS last FROM log GROUP BY 1),
tried AS (SELECT example_id, attempt, min(line) AS a, max(line) AS z FROM log GROUP BY 1, 2)
SELECT 'one_run' AS "check", count(*) AS violations FROM log WHERE run <> 'r' UNION ALL SELECT 'examples_of_the_queue', count(*) FROM log WHERE example_id % 10 = 7
UNION ALL SELECT 'attempts_contiguous', count(*) FROM (SELECT example_id FROM per WHERE n <> d OR lo <> 1 OR hi <> n UNION SELECT x.example_id FROM tried x JOIN tried y ON y.example_id = x.example_id AND y.attempt + 1 = x.attempt WHERE x.a < y.z)
UNION ALL SELECT 'nothing_after_success', count(*) FROM per WHERE last > first_won""")
def label_log_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Broken rules of a log made of the events: other runs, unknown examples, attempts out of order, tries after a success."""
    from threadloom.operators.ranking import rank_within

    rows = rank_within(table(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", [F.col("event_id")], "n")
    n = F.col("n") + (F.col("event_id") % 97 == 0).cast("int")
    log = rows.select(F.col("user_id").alias("example_id"), F.col("event_id").alias("line"), n.alias("attempt"), F.when(F.col("event_type") == "purchase", "success").otherwise("failure").alias("status"), F.when(F.col("event_id") % 89 == 0, "x").otherwise("r").alias("run"))
    log = Workspace(spark, "log").save(log)
    return label_log.log_checks(log, log.select("example_id").distinct().where("example_id % 10 <> 7"), "r")


@query(f"""WITH q AS (SELECT queue_name, queue_position AS p, lower({_t('example_id')}) AS e FROM annotation_queue), d AS (SELECT DISTINCT queue_name, e FROM q WHERE p <= 50),
r AS (SELECT queue_name, e, ['complete', 'judgment_saved', 'skipped'][CAST(min(p) % 4 AS INTEGER) + 1] AS s, min(p) % 9 = 0 AS stale FROM q GROUP BY 1, 2 HAVING min(p) % 4 < 3)
SELECT *, complete_current = expected AS ready FROM (SELECT queue_name, count(*) AS expected, count(*) FILTER (WHERE s = 'complete') AS complete, count(*) FILTER (WHERE s = 'judgment_saved') AS judgment_saved, count(*) FILTER (WHERE s = 'skipped') AS skipped,
  count(*) FILTER (WHERE s IS NULL) AS missing, count(*) FILTER (WHERE stale) AS stale, count(*) FILTER (WHERE s = 'complete' AND NOT stale) AS complete_current FROM d LEFT JOIN r USING (queue_name, e) GROUP BY 1)""")
def queue_completion(spark: SparkSession, folder: str) -> DataFrame:
    """State of the first 50 positions of every queue: complete, skipped, missing, made under another contract."""
    queue = table(spark, folder, "annotation_queue").select("queue_name", "queue_position", ids.name_id(F.col("example_id")).alias("example_id"))
    first = queue.groupBy("queue_name", "example_id").agg(F.min("queue_position").alias("p"))
    named = F.create_map(F.lit(0), F.lit("complete"), F.lit(1), F.lit("judgment_saved"), F.lit(2), F.lit("skipped"))
    records = first.where("p % 4 < 3").select("queue_name", "example_id", named[(F.col("p") % 4).cast("int")].alias("status"), F.when(F.col("p") % 9 == 0, "v1").otherwise("v2").alias("guide_version"))
    return label_log.completion(queue, records, validators.stale(records, {"guide_version": "v2"}), 50)


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 7 AS revision FROM events),
f AS (SELECT user_id, event_id, n, revision, revision AS revised FROM s WHERE n = 1 UNION ALL SELECT s.user_id, s.event_id, s.n, s.revision, greatest(s.revision, f.revised + 1) FROM s JOIN f ON f.user_id = s.user_id AND s.n = f.n + 1)
SELECT user_id, event_id, revised FROM f""")
def revisions(spark: SparkSession, folder: str) -> DataFrame:
    """Revisions that always rise, over the events of each key."""
    rows = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_id") % 7).alias("revision"))
    return label_log.revised(rows, "user_id", "event_id", "revision").select("user_id", "event_id", "revised")


# -- ledger --------------------------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_id, event_type AS m, (epoch_us(ts) // 1000) / 1000.0 AS t, CAST(floor(value) AS BIGINT) AS a FROM events),
w AS (SELECT x.event_id, x.t AS now, x.a AS cost, y.t, y.event_id AS other, sum(y.a) OVER (PARTITION BY x.event_id ORDER BY y.t DESC, y.event_id DESC) AS later, count(*) OVER (PARTITION BY x.event_id ORDER BY y.t DESC, y.event_id DESC) AS places
  FROM r x JOIN r y ON y.m = x.m AND y.t <= x.t AND y.t > x.t - 60),
out_ AS (SELECT event_id, max(t) FILTER (WHERE later + cost > 40 OR places + 1 > 3) + 60.1 AS free, max(t) AS latest, any_value(now) AS now FROM w GROUP BY 1)
SELECT r.event_id AS request, CASE WHEN r.a <= 40 THEN round(greatest(0, coalesce(free - o.now, 0), o.latest + (60.0 / 3 + 0.1) - o.now), 3) END AS wait, CASE WHEN r.a > 40 THEN 'single request above a ceiling' END AS pause FROM r JOIN out_ o USING (event_id)""")
def ledger_waits(spark: SparkSession, folder: str) -> DataFrame:
    """How long each event would have to wait for its budget if all events before it were reservations."""
    rows = table(spark, folder, "events").select("event_id", F.col("event_type").alias("model"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) / 1000).alias("t"), F.floor("value").alias("a"))
    asked = rows.select(F.col("event_id").alias("request"), "model", F.col("t").alias("now"), F.col("a").alias("input_tokens"), F.lit(0).alias("output_tokens"))
    none = F.from_json(F.lit("null"), "limit_tokens bigint, limit_requests bigint, remaining_requests bigint, remaining_tokens bigint, reset_requests_seconds double, reset_tokens_seconds double")
    book = rows.select("model", F.lit("reservation").alias("kind"), F.col("t").alias("time"), F.col("a").alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(None).cast("string").alias("limit_category"), none.alias("headers"))
    return ledger.waits(asked, book, ledger.Budget(requests_per_minute=3, tokens_per_minute=40)).select("request", F.round("wait", 3).alias("wait"), "pause")


@query("""SELECT event_id, CAST(event_id * 60 + event_id % 60 AS DOUBLE) + (event_id % 10) / 10.0 AS seconds, CAST(ceil(event_id * 1.1::DOUBLE) AS BIGINT) + 512 AS reserved,
  CASE WHEN event_id % 5 = 0 THEN 'billing' WHEN event_id % 3 = 0 THEN 'daily' WHEN event_id % 11 = 0 THEN 'quota_unavailable' WHEN event_id % 2 = 0 THEN 'temporary' ELSE 'unknown' END AS refusal,
  greatest(least(60.0, 5.0 * pow(2.0, least(event_id % 30, 20)) + (event_id % 3)), greatest(CAST(event_id % 100 AS DOUBLE) - 10, 0)) AS wait, CASE WHEN event_id % 4 < 3 THEN event_id END AS used FROM events""")
def transport_values(spark: SparkSession, folder: str) -> DataFrame:
    """Durations, reservations, kinds of refusal, waits and usage read from what services say, made by rule from the events."""
    e = F.col("event_id")
    rows = table(spark, folder, "events").select("event_id")
    said = F.concat(e, F.lit("m"), e % 60, F.lit("."), e % 10, F.lit("s"))
    reasons = F.when(e % 5 == 0, F.array(F.lit("BILLING_DISABLED"))).otherwise(F.array().cast("array<string>"))
    quotas = F.when(e % 3 == 0, F.array(F.lit("RequestsPerDay"))).when(e % 2 == 0, F.array(F.lit("Requests_per-minute"))).otherwise(F.array(F.lit("Requests")))
    body = F.when(e % 4 < 3, F.concat(F.lit('{"usage": {"total_tokens": '), e, F.lit("}}"))).otherwise(F.lit('{"usage": {"total_tokens": "many"}}'))
    return rows.select(
        "event_id", transport.seconds(said).alias("seconds"), transport.reservation(e).alias("reserved"), transport.refusal(F.lit(429), reasons, quotas, e % 11 == 0, F.lit(False)).alias("refusal"),
        transport.retry_wait(e % 30, (e % 3).cast("double"), (e % 100).cast("double"), F.lit(10.0), 5, 60).alias("wait"), transport.usage(body)["total_tokens"].alias("used"),
    )


# -- evaluation: the stratum of a queued example as the prediction, the bucket of its text as the truth ------------------------------------

_EVAL = f"""inputs AS (SELECT lower({_t('example_id')}) AS example_id, min(sampling_stratum) AS intent, min(queue_position) AS p FROM annotation_queue GROUP BY 1),
labels AS (SELECT {_EX} AS example_id, min({_BUCKET_SQL}) AS truth FROM support_examples GROUP BY 1),
rows AS (SELECT i.example_id, i.intent, l.truth, l.truth = 'security' AS should, CASE WHEN p % 4 = 0 OR p % 6 = 0 THEN 'proposed_escalate' ELSE 'proposed_auto_handle' END AS decision, p % 6 = 0 AS fallback, p % 4 = 0 AS bare FROM inputs i JOIN labels l USING (example_id))"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    inputs = table(spark, folder, "annotation_queue").groupBy(ids.name_id(F.col("example_id")).alias("example_id")).agg(F.min("sampling_stratum").alias("intent"), F.min("queue_position").alias("p"))
    bucket = sampling.bucket(F.col("customer_text_normalized"), F.col("context_tweet_ids"))
    labels = table(spark, folder, "support_examples").groupBy(ids.name_id(F.col("example_id")).alias("example_id")).agg(F.min(bucket).alias("intent"))
    labels = labels.select("example_id", "intent", F.lit("judgment_saved").alias("status"), F.when(F.col("intent") == "security", "yes").otherwise("no").alias("escalate"))
    found = F.when(F.col("p") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("example_id"))
    made = evaluation.combined(F.lit(None).cast("string"), F.when(F.col("p") % 6 == 0, "provider_error"), found, F.lit(False), True)
    cache = inputs.select("example_id", "intent", made.alias("_m"), (F.col("p") % 6 == 0).alias("fallback"), F.lit(None).cast("string").alias("error")).select("example_id", "intent", "_m.*", "fallback", "error")
    return evaluation.scored(evaluation.with_truth(inputs.select("example_id"), labels, required=True), cache)


@query(f"""WITH {_EVAL} SELECT count(*) AS total, count(DISTINCT intent) AS predicted_intents, round(avg((decision = 'proposed_escalate')::INTEGER), 6) AS escalation_rate, round(avg(fallback::INTEGER), 6) AS fallback_rate, round(avg(bare::INTEGER), 6) AS empty_retrieval_rate FROM rows""")
def evaluation_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of escalations, fallbacks and empty searches over scored predictions."""
    return evaluation.diagnostics(_scored(spark, folder))


@query(f"""WITH {_EVAL} SELECT example_id, 'intent' AS error FROM rows WHERE intent IS DISTINCT FROM truth UNION ALL SELECT example_id, 'unsafe_auto_handle' FROM rows WHERE should AND decision = 'proposed_auto_handle'""")
def evaluation_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of wrong intents and of cases that should have been escalated."""
    return evaluation.errors(_scored(spark, folder))


@query(f"""WITH {_EVAL}, texts AS (SELECT {_EX} AS example_id, min(customer_text_normalized) AS text FROM support_examples GROUP BY 1) SELECT example_id, truth, intent, text FROM rows LEFT JOIN texts USING (example_id) WHERE NOT fallback AND truth IS DISTINCT FROM intent""")
def diagnosed_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Mismatches without fallbacks, with their texts."""
    texts = table(spark, folder, "support_examples").groupBy(ids.name_id(F.col("example_id")).alias("example_id")).agg(F.min("customer_text_normalized").alias("text"))
    return evaluation.diagnosed(_scored(spark, folder), texts)


@query(f"""WITH {_EVAL}, allowed AS (SELECT unnest({[n for n, _ in sampling.COVERAGE] + ['refunds']!r}) AS label), have AS (SELECT truth AS label, count(*) AS n FROM rows GROUP BY 1)
SELECT coalesce(h.label, a.label) AS label, coalesce(n, 0) AS n, n IS NULL AS missing, a.label IS NULL AS unknown FROM have h FULL JOIN allowed a ON a.label = h.label""")
def class_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Labels per class, with classes that lack and labels that are not allowed."""
    return evaluation.class_summary(_scored(spark, folder).select(F.col("truth").alias("intent")), [n for n, _ in sampling.COVERAGE] + ["refunds"])


@query(f"SELECT count(*) AS examples, true AS better FROM (SELECT DISTINCT {_EX} FROM support_examples)")
def intent_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A classifier of coverage buckets trained on every example; ``better``: it is right more often than the majority class."""
    bucket = sampling.bucket(F.col("customer_text_normalized"), F.col("context_tweet_ids"))
    rows = table(spark, folder, "support_examples").groupBy(ids.name_id(F.col("example_id")).alias("id")).agg(F.min_by(F.struct(F.col("customer_text_normalized").alias("text"), bucket.alias("intent")), "customer_text_normalized").alias("_r"))
    rows = Workspace(spark, "examples").save(rows.select("id", "_r.*"))
    model = IntentModel(max_features=2000).fit(rows)
    both = model.predict(rows.select("id", "text")).withColumnRenamed("intent", "said").join(model.predict(rows.select("id", "text"), trivial=True).withColumnRenamed("intent", "most"), "id")
    right = lambda c: F.count_if(F.col(c) == F.col("intent"))
    return rows.join(both, "id").agg(F.count("*").alias("examples"), (right("said") > right("most")).alias("better"))
