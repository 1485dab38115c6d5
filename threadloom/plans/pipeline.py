"""Queries of the conversation pipeline: ingest, threads, preparation, splits, samples, search and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import hashing, ids, text
from threadloom.operators import extraction, labels, retrieval, sampling, similarity, splitting
from threadloom.operators.graph import connected_components, hierarchy
from threadloom.operators.ranking import rank_within
from threadloom.plans.problems import sql_id
from threadloom.sources.tables import table
from threadloom.workspace import Workspace

#: The support author of the test tables, a parameter everywhere below this module.
AUTHOR = "TuneHarborCares"
SEED = 42
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


def _joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203)"
_TRIM = f"trim({{}}, {_BLANK})"


def _t(c: str) -> str:
    return _TRIM.format(c)


_PARSED = f"""parsed0 AS (SELECT source_record, {sql_id('tweet_id')} AS id, nullif({_t('author_id')}, '') AS author,
  CASE lower({_t('inbound')}) WHEN 'true' THEN true WHEN 'false' THEN false END AS inbound,
  CASE WHEN {_t('created_at')} SIMILAR TO '[A-Za-z].*' THEN try_strptime({_t('created_at')}, '%a %b %d %H:%M:%S %z %Y')
       WHEN {_t('created_at')} SIMILAR TO '[0-9].*' THEN try_cast({_t('created_at')} AS TIMESTAMPTZ) END AS moment,
  text, nullif({_t('created_at')}, '') AS stamp, nullif({_t('text')}, '') AS shown,
  list_filter([{sql_id('x')} FOR x IN string_split(coalesce(response_tweet_id, ''), ',')], lambda x: x IS NOT NULL) AS r0,
  list_filter([{_t('x')} FOR x IN string_split(coalesce(in_response_to_tweet_id, ''), ',')], lambda x: x <> '') AS parts FROM records),
parsed AS (SELECT *, list_filter(r0, lambda x, i: list_position(r0, x) = i) AS responses, CASE WHEN len(parts) = 1 THEN {sql_id('parts[1]')} END AS parent FROM parsed0),
stats AS (SELECT id, min(source_record) AS source_record, count(*) AS copies, count(DISTINCT row(author, inbound, moment, text, array_to_string(responses, ','), parent)) AS variants FROM parsed WHERE id IS NOT NULL GROUP BY id),
messages AS (SELECT p.*, s.copies, s.variants FROM parsed p JOIN stats s USING (source_record))"""

_THREADS = f"""{_PARSED},
links AS (SELECT id, parent FROM messages WHERE parent IN (SELECT id FROM messages)),
both_ways AS (SELECT id AS a, parent AS b FROM links UNION SELECT parent, id FROM links),
spread AS (SELECT a AS node, least(a, min(b)) AS label, 0 AS i FROM both_ways GROUP BY a
  UNION ALL
  SELECT node, min(label) AS label, i FROM (
    SELECT e.a AS node, w.label, w.i + 1 AS i FROM both_ways e JOIN spread w ON w.node = e.b WHERE w.i < 600
    UNION ALL SELECT w.node, w.label, w.i + 1 FROM spread w WHERE w.i < 600) GROUP BY node, i),
every AS (SELECT m.id, m.author, coalesce(s.label, m.id) AS root_label FROM messages m LEFT JOIN (SELECT * FROM spread WHERE i = 600) s ON s.node = m.id),
members AS (SELECT id, root_label FROM every WHERE root_label IN (SELECT root_label FROM every WHERE author = '{AUTHOR}'))"""

_RELATED = f"""{_THREADS},
inside AS (SELECT m.* FROM messages m JOIN members USING (id)),
claims AS (SELECT DISTINCT id AS parent, unnest(responses) AS child FROM inside),
direct AS (SELECT i.parent, i.id AS child, true AS direct, c.child IS NOT NULL AS claimed,
  CASE WHEN p.id IS NULL THEN 'missing_parent_target' WHEN c.child IS NOT NULL THEN 'consistent' WHEN len(p.responses) > 0 THEN 'parent_response_disagrees' ELSE 'parent_response_unspecified' END AS status
  FROM inside i LEFT JOIN messages p ON p.id = i.parent LEFT JOIN claims c ON c.parent = i.parent AND c.child = i.id WHERE i.parent IS NOT NULL),
only_claimed AS (SELECT c.parent, c.child, false AS direct, true AS claimed,
  CASE WHEN m.id IS NULL THEN 'response_target_missing' WHEN m.parent IS NULL THEN 'response_only_unconfirmed' ELSE 'conflicting_parent_claim' END AS status
  FROM claims c LEFT JOIN messages m ON m.id = c.child WHERE m.id IS NULL OR m.parent IS NULL OR m.parent <> c.parent),
related AS (SELECT * FROM direct UNION ALL SELECT * FROM only_claimed)"""

_ROLLUP = f"""per AS (SELECT root_label, count(*) AS messages, count(*) FILTER (WHERE inbound) AS inbound_messages, count(*) FILTER (WHERE NOT inbound) AS outbound_messages,
  count(*) FILTER (WHERE m.author = '{AUTHOR}') AS support_messages, coalesce(list_sort(list(DISTINCT m.author) FILTER (WHERE NOT inbound AND m.author <> '{AUTHOR}')), []) AS others,
  min(moment) AS started, max(moment) AS ended, bool_or(variants > 1) AS conflict FROM messages m JOIN members USING (id) GROUP BY root_label)"""

_EXAMPLES = f"""{_RELATED}, {_ROLLUP},
up AS (SELECT id, id AS cur, [id] AS trail, false AS looped FROM inside
  UNION ALL SELECT u.id, l.parent, CASE WHEN list_contains(trail, l.parent) THEN trail ELSE list_append(trail, l.parent) END, list_contains(trail, l.parent)
  FROM up u JOIN links l ON l.id = u.cur WHERE NOT looped),
chain AS (SELECT id, arg_max(trail, len(trail)) AS trail, bool_or(looped) AS looped FROM up GROUP BY id),
ctx AS (SELECT c.id, list(m.id ORDER BY m.moment IS NULL, m.moment, m.source_record, m.id) AS context FROM (SELECT id, unnest(trail[2:]) AS a FROM chain) c JOIN messages m ON m.id = c.a GROUP BY c.id),
replies AS (SELECT parent AS id, list(id ORDER BY moment IS NULL, moment, source_record, id) AS replies, bool_or(shown IS NULL) AS mute FROM inside WHERE author = '{AUTHOR}' AND NOT inbound AND parent IS NOT NULL GROUP BY parent),
said AS (SELECT DISTINCT c.parent AS id FROM claims c JOIN messages m ON m.id = c.child WHERE m.author = '{AUTHOR}'),
crossed AS (SELECT DISTINCT b.root_label FROM related r JOIN messages m ON m.id = r.child JOIN members b ON b.id = r.parent WHERE NOT r.direct AND r.status <> 'response_target_missing' AND NOT m.inbound AND coalesce(m.author, '') <> '{AUTHOR}'),
looping AS (SELECT DISTINCT b.root_label FROM chain c JOIN members b USING (id) WHERE looped),
built AS (SELECT i.id AS customer, coalesce(c.context, []) AS context, coalesce(r.replies, []) AS replies,
  list_sort(list_filter([CASE WHEN r.replies IS NULL THEN 'no_verified_direct_reply' END, CASE WHEN len(p.others) > 0 OR x.root_label IS NOT NULL THEN 'cross_brand_ambiguous' END,
    CASE WHEN p.conflict THEN 'conflicting_duplicates' END, CASE WHEN o.root_label IS NOT NULL THEN 'cyclic_relationships' END, CASE WHEN i.shown IS NULL THEN 'missing_customer_text' END,
    CASE WHEN r.mute THEN 'missing_reply_text' END], lambda x: x IS NOT NULL)) AS reasons
  FROM inside i JOIN members b USING (id) JOIN per p ON p.root_label = b.root_label LEFT JOIN replies r ON r.id = i.id LEFT JOIN said s ON s.id = i.id LEFT JOIN ctx c ON c.id = i.id
  LEFT JOIN crossed x ON x.root_label = b.root_label LEFT JOIN looping o ON o.root_label = b.root_label WHERE i.inbound AND (r.id IS NOT NULL OR s.id IS NOT NULL))"""


# -- ingest ------------------------------------------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.parsed(table(spark, folder, "records"))


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    return Workspace(spark, "messages").save(extraction.canonical(_parsed(spark, folder)))


def _members(messages: DataFrame) -> DataFrame:
    out = extraction.threads(messages, AUTHOR).select("id", F.col("root_label").cast("string").alias("thread_id"))
    return Workspace(messages.sparkSession, "members").save(out)


@query(f"""WITH {_PARSED} SELECT source_record, CAST(id AS VARCHAR) AS id, author, inbound, CAST(epoch_us(moment) AS VARCHAR) AS moment_us, array_to_string(responses, ',') AS responses, CAST(parent AS VARCHAR) AS parent,
  array_to_string(list_sort(list_filter([CASE WHEN stamp IS NULL THEN 'missing_timestamp' WHEN moment IS NULL THEN 'invalid_timestamp' END, CASE WHEN shown IS NULL THEN 'missing_text' END,
  CASE WHEN inbound IS NULL THEN 'invalid_inbound' END, CASE WHEN len(parts) > 0 AND parent IS NULL THEN 'invalid_parent_format' END, CASE WHEN id IS NULL THEN 'missing_id' END], lambda x: x IS NOT NULL)), ',') AS flags FROM parsed""")
def parsed_records(spark: SparkSession, folder: str) -> DataFrame:
    """Typed columns and quality flags of every raw row."""
    plain = lambda c, n: c.cast("string").alias(n)
    return _parsed(spark, folder).select("source_record", plain(F.col("id"), "id"), "author", "inbound", plain(F.unix_micros("moment"), "moment_us"), _joined(F.col("responses")).alias("responses"), plain(F.col("parent"), "parent"), _joined(F.col("flags")).alias("flags"))


@query(f"WITH {_PARSED} SELECT source_record, id, author, copies, variants FROM messages")
def canonical_records(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of each id, with the number of its copies and of their variants."""
    return extraction.canonical(_parsed(spark, folder)).select("source_record", "id", "author", "copies", "variants")


@query(f"WITH {_PARSED} SELECT p.source_record, p.id, p.author, s.copies, s.variants FROM parsed p JOIN stats s USING (id) WHERE s.copies > 1")
def duplicate_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of an id that came more than once."""
    return extraction.duplicates(_parsed(spark, folder))


@query(f"""WITH {_PARSED} SELECT count(*) AS ids, count(*) FILTER (WHERE copies > 1) AS duplicated_ids, CAST(sum(copies - 1) AS BIGINT) AS extra_rows, count(*) FILTER (WHERE variants > 1) AS conflicting_ids FROM stats""")
def duplicate_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = canonical_records(spark, folder)
    return rows.agg(F.count("*").alias("ids"), F.count_if(F.col("copies") > 1).alias("duplicated_ids"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra_rows"), F.count_if(F.col("variants") > 1).alias("conflicting_ids"))


@query(f"""WITH {_PARSED} SELECT count(*) AS n, count(*) FILTER (WHERE id IS NULL) AS missing_id, count(*) FILTER (WHERE stamp IS NULL) AS missing_timestamp,
  count(*) FILTER (WHERE stamp IS NOT NULL AND moment IS NULL) AS invalid_timestamp, count(*) FILTER (WHERE shown IS NULL) AS missing_text, count(*) FILTER (WHERE inbound IS NULL) AS invalid_inbound FROM parsed""")
def ingest_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of rows by quality flag."""
    rows = _parsed(spark, folder)
    has = lambda f: F.count_if(F.array_contains("flags", f)).alias(f)
    return rows.agg(F.count("*").alias("n"), *[has(f) for f in ("missing_id", "missing_timestamp", "invalid_timestamp", "missing_text", "invalid_inbound")])


@query(f"WITH {_PARSED} SELECT lower(author) AS name, count(*) AS n, count(DISTINCT author) AS spellings, array_to_string(list_sort(list(DISTINCT author)), ',') AS authors FROM parsed WHERE lower(author) = lower('{AUTHOR}') GROUP BY 1")
def author_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of the support author."""
    rows = _parsed(spark, folder).where(F.lower("author") == AUTHOR.lower())
    return rows.groupBy(F.lower("author").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("spellings"), F.array_join(F.array_sort(F.collect_set("author")), ",").alias("authors"))


@query("SELECT source_record, sha256(CAST(source_record AS VARCHAR)) AS digest FROM records ORDER BY digest LIMIT 100")
def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred rows that an audit looks at, by digest."""
    return extraction.audit_sample(table(spark, folder, "records").select("source_record"), "source_record", 100).withColumn("digest", F.sha2(F.col("source_record").cast("string"), 256))


@query("SELECT count(*) AS n, count(DISTINCT inbound) AS spellings, array_to_string(list_sort(list(DISTINCT inbound)), '|') AS raw_values FROM records")
def inbound_values(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct raw spellings of the inbound flag."""
    return table(spark, folder, "records").agg(F.count("*").alias("n"), F.count_distinct("inbound").alias("spellings"), F.array_join(F.array_sort(F.collect_set("inbound")), "|").alias("raw_values"))


@query(f"WITH {_PARSED} SELECT id AS parent, unnest(responses) AS child, CAST(unnest(range(0, len(responses))) AS INTEGER) AS ordinal FROM messages")
def response_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claimed answers with their place."""
    return extraction.claims(extraction.canonical(_parsed(spark, folder)))


# -- threads -----------------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_THREADS} SELECT id, root_label FROM every")
def thread_components(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with the smallest message of its thread."""
    return extraction.threads(_messages(spark, folder)).select("id", "root_label")


@query(f"WITH RECURSIVE {_THREADS} SELECT id, root_label FROM members")
def relevant_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of threads in which the support author wrote."""
    return extraction.threads(_messages(spark, folder), AUTHOR).select("id", "root_label")


@query(f"""WITH RECURSIVE {_PARSED}, links AS (SELECT id, parent FROM messages WHERE parent IN (SELECT id FROM messages)),
up AS (SELECT id, parent AS cur, [id] AS trail FROM links UNION ALL SELECT u.id, l.parent, list_append(u.trail, u.cur) FROM up u JOIN links l ON l.id = u.cur WHERE NOT list_contains(u.trail, u.cur))
SELECT DISTINCT id FROM up WHERE cur = id""")
def cycle_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Messages on a cycle of direct parents."""
    tree = hierarchy(_messages(spark, folder), F.col("id"), F.col("parent"))
    return tree.where("in_cycle = 1 and depth = 0").select(F.col("node").alias("id"))


@query(f"WITH RECURSIVE {_RELATED} SELECT parent, child, direct, claimed, status FROM related")
def relationship_status(spark: SparkSession, folder: str) -> DataFrame:
    """Every direct or claimed link of relevant threads, with its status."""
    m = _messages(spark, folder)
    return extraction.relationships(m, _members(m))


@query(f"WITH RECURSIVE {_RELATED} SELECT status, count(*) AS n FROM related GROUP BY status")
def relationship_counts(spark: SparkSession, folder: str) -> DataFrame:
    return relationship_status(spark, folder).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_THREADS}, {_ROLLUP} SELECT CAST(root_label AS VARCHAR) AS thread_id, messages, inbound_messages, outbound_messages, support_messages, array_to_string(others, ',') AS others,
  CAST(epoch_us(started) AS VARCHAR) AS started_us, CAST(epoch_us(ended) AS VARCHAR) AS ended_us, conflict AS conflicting_duplicates FROM per""")
def thread_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, authors and time span of every relevant thread."""
    m = _messages(spark, folder)
    out = extraction.rollup(m, _members(m), AUTHOR)
    return out.select("thread_id", "messages", "inbound_messages", "outbound_messages", "support_messages", _joined(F.col("other_outbound_authors")).alias("others"), F.unix_micros("started_at").cast("string").alias("started_us"), F.unix_micros("ended_at").cast("string").alias("ended_us"), "conflicting_duplicates")


_FLAGS = """list_filter([CASE WHEN stamp IS NULL THEN 'missing_timestamp' WHEN moment IS NULL THEN 'invalid_timestamp' END, CASE WHEN shown IS NULL THEN 'missing_text' END,
  CASE WHEN inbound IS NULL THEN 'invalid_inbound' END, CASE WHEN len(parts) > 0 AND parent IS NULL THEN 'invalid_parent_format' END], lambda x: x IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_RELATED}, flagged AS (SELECT id, unnest({_FLAGS}) AS flag FROM messages UNION ALL SELECT unnest([parent, child]), status FROM related WHERE status NOT IN ('consistent', 'parent_response_unspecified'))
SELECT CAST(root_label AS VARCHAR) AS thread_id, array_to_string(list_sort(list(DISTINCT flag)), ',') AS flags FROM flagged JOIN members USING (id) GROUP BY 1""")
def thread_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of the messages and links of every relevant thread."""
    m = _messages(spark, folder)
    members = _members(m)
    out = extraction.flag_union(extraction.relationships(m, members), m, members)
    return out.select("thread_id", _joined(F.col("flags")).alias("flags"))


@query(f"""WITH RECURSIVE {_THREADS}, sizes AS (SELECT count(*) AS n FROM members GROUP BY root_label)
SELECT count(*) AS threads, min(n) AS smallest, round(median(n), 6) AS middle, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS largest FROM sizes""")
def thread_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Exact order statistics of thread sizes."""
    n = _members(_messages(spark, folder)).groupBy("thread_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("threads"), F.min("n").alias("smallest"), F.round(F.median("n"), 6).alias("middle"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.9), 6).alias("p90"), F.max("n").alias("largest"))


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    m = _messages(spark, folder)
    return extraction.examples(m, _members(m), AUTHOR)


@query(f"WITH RECURSIVE {_EXAMPLES} SELECT customer, array_to_string(context, ',') AS context, array_to_string(replies, ',') AS replies FROM built WHERE len(reasons) = 0")
def extracted_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Customer messages with preceding context and verified replies."""
    return _examples(spark, folder).where("size(reasons) = 0").select("customer", _joined(F.col("context")).alias("context"), _joined(F.col("replies")).alias("replies"))


@query(f"WITH RECURSIVE {_EXAMPLES} SELECT customer, array_to_string(replies, ',') AS replies, array_to_string(reasons, ',') AS reasons FROM built WHERE len(reasons) > 0")
def excluded_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate messages that make no example, with the reasons."""
    return _examples(spark, folder).where("size(reasons) > 0").select("customer", _joined(F.col("replies")).alias("replies"), _joined(F.col("reasons")).alias("reasons"))


@query(f"WITH RECURSIVE {_EXAMPLES} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM built) GROUP BY reason")
def exclusion_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _examples(spark, folder).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# -- texts -------------------------------------------------------------------------------------------------------------------------

_SPACES = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
_REPAIRED = "coalesce(text, '')"
for _broken, _right in text.REPAIRS:
    _REPAIRED = f"replace({_REPAIRED}, '{_broken}', '{_right}')"
_NORMAL = f"trim(regexp_replace(nfc_normalize(replace(replace({_REPAIRED}, chr(8203), ''), chr(65279), '')), '{_SPACES}', ' ', 'g'), ' ')"
_W = r"\p{L}\p{N}_"
_REDACT = rf"""r0 AS (SELECT source_record, {_NORMAL} AS t FROM records),
r1 AS (SELECT *, regexp_replace(t, '(?i)[{_W}.+-]+@[{_W}.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g') AS a FROM r0),
r2 AS (SELECT *, regexp_replace(a, '(?i)(?:https?://|www\.)[^\s<>()]*?([.,!?;:)\]}}]*)([\s<>()]|$)', '[URL]\1\2', 'g') AS b FROM r1),
r3 AS (SELECT *, regexp_replace(b, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b', '[IP]', 'g') AS c FROM r2),
r4 AS (SELECT *, regexp_replace(c, '(^|[^{_W}.])(?:\+?\d[\d\s().-]{{7,}}\d)(\b)', '\1[PHONE]', 'g') AS d FROM r3),
r5 AS (SELECT *, regexp_replace(d, '(?i)(^|[^{_W}])@{AUTHOR}([^A-Za-z0-9_]|$)', '\1[BRAND]\2', 'g') AS e FROM r4),
r6 AS (SELECT *, regexp_replace(e, '(^|[^{_W}])@([A-Za-z0-9_]+)', '\1[CUSTOMER]', 'g') AS f FROM r5),
r7 AS (SELECT *, regexp_replace(f, '\b\d{{6,}}\b', '[NUMBER]', 'g') AS g FROM r6)"""


@query(f"SELECT source_record, {_NORMAL} AS text FROM records")
def normalized_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Message texts with repaired punctuation and white space."""
    return table(spark, folder, "records").select("source_record", text.normalized(F.col("text")).alias("text"))


@query(f"WITH {_REDACT} SELECT source_record, g AS text FROM r7")
def redacted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Normalized message texts with placeholders for addresses, numbers and handles."""
    rows = table(spark, folder, "records").select("source_record", text.normalized(F.col("text")).alias("t"))
    return rows.select("source_record", text.redacted(F.col("t"), [AUTHOR]).alias("text"))


@query(rf"""WITH {_REDACT} SELECT CAST(sum(len(regexp_extract_all(t, '(?i)[{_W}.+-]+@[{_W}.-]+\.[A-Za-z]{{2,}}'))) AS BIGINT) AS email,
  CAST(sum((len(d) - len(replace(d, '[PHONE]', ''))) / 7) AS BIGINT) - CAST(sum((len(c) - len(replace(c, '[PHONE]', ''))) / 7) AS BIGINT) AS phone,
  CAST(sum((len(b) - len(replace(b, '[URL]', ''))) / 5) AS BIGINT) - CAST(sum((len(a) - len(replace(a, '[URL]', ''))) / 5) AS BIGINT) AS url, CAST(sum((len(c) - len(replace(c, '[IP]', ''))) / 4) AS BIGINT) - CAST(sum((len(b) - len(replace(b, '[IP]', ''))) / 4) AS BIGINT) AS ip_address,
  CAST(sum((len(f) - len(replace(f, '[CUSTOMER]', ''))) / 10) AS BIGINT) - CAST(sum((len(e) - len(replace(e, '[CUSTOMER]', ''))) / 10) AS BIGINT) AS customer_handle,
  CAST(sum((len(e) - len(replace(e, '[BRAND]', ''))) / 7) AS BIGINT) AS brand_handle, CAST(sum((len(g) - len(replace(g, '[NUMBER]', ''))) / 8) AS BIGINT) AS long_number FROM r7""")
def redaction_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How often each class was replaced."""
    rows = table(spark, folder, "records").select(text.normalized(F.col("text")).alias("t"))
    steps = {name: count for name, count, _ in text.redaction_steps(F.col("t"), [AUTHOR])}
    return rows.agg(*[F.sum(steps[k]).cast("bigint").alias(k) for k in ("email", "url", "ip_address", "phone", "brand_handle", "customer_handle", "long_number")])


_FORM = f"trim(regexp_replace(replace(lower(nfc_normalize(customer_text_normalized)), 'º', 'o'), '{_SPACES}', ' ', 'g'), ' ')"
_EX = f"lower({_t('support_examples.example_id')})"
_FORMS = f"forms AS (SELECT {_FORM} AS form, min({_EX}) AS representative, count(DISTINCT {_EX}) AS copies FROM support_examples GROUP BY 1)"
_SHINGLED = f"""{_FORMS},
shingled AS (SELECT DISTINCT representative, form, substring(form, i, 4) AS shingle FROM (SELECT *, unnest(range(1, greatest(1, length(form) - 3) + 1)) AS i FROM forms WHERE length(form) >= 24)),
freq AS (SELECT shingle, count(*) AS df FROM shingled GROUP BY 1),
rare AS (SELECT representative, form, shingle, df FROM shingled JOIN freq USING (shingle) WHERE df BETWEEN 2 AND 100
  QUALIFY row_number() OVER (PARTITION BY representative ORDER BY df, shingle) <= 4)"""


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "support_examples").select("example_id", text.duplicate_form(F.col("customer_text_normalized")).alias("form"))
    return Workspace(spark, "forms").save(similarity.exact_groups(rows, ids.name_id(F.col("example_id")), F.col("form")))


@query(f"WITH {_FORMS} SELECT form, representative, copies FROM forms WHERE copies > 1")
def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that several examples share."""
    return _forms(spark, folder).where("copies > 1").select("form", "representative", "copies")


@query(f"WITH {_SHINGLED} SELECT shingle, df FROM freq")
def shingle_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency of every character shingle."""
    return similarity.shingle_frequency(_forms(spark, folder), 4, 24)


@query(f"WITH {_SHINGLED} SELECT representative, shingle, df FROM rare")
def rare_shingles(spark: SparkSession, folder: str) -> DataFrame:
    """The four rarest shared shingles of every text."""
    return similarity.rare_shingles(_forms(spark, folder), 4, 24, 4, 100).select("representative", "shingle", "df")


@query(f"""WITH {_SHINGLED} SELECT DISTINCT a.representative AS left_id, b.representative AS right_id FROM rare a JOIN rare b USING (shingle)
WHERE a.form < b.form AND least(length(a.form), length(b.form)) >= 0.92 * greatest(length(a.form), length(b.form))""")
def near_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of texts in one block of a rare shingle with near lengths."""
    return similarity.candidates(_forms(spark, folder)).select("left_id", "right_id")


@query()
def near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of texts with a matched ratio of at least 0.92."""
    return similarity.near_pairs(_forms(spark, folder)).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


_SETS = r"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
cls AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS k, count(*) AS n FROM sh GROUP BY doc_id),
few AS (SELECT doc_id, 'few:' || array_to_string(coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []), ' ') AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM cls)),
every AS (SELECT doc_id, k FROM cls UNION ALL SELECT doc_id, k FROM few),
reps AS (SELECT k, min(doc_id) AS class_id, any_value(n) AS n FROM cls GROUP BY k)"""


@query(f"""WITH {_SETS}, rs AS (SELECT sh.* FROM sh JOIN reps ON reps.class_id = sh.doc_id),
both_in AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, count(*) AS common FROM rs a JOIN rs b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT left_id, right_id, round(common / (x.n + y.n - common), 6) AS similarity FROM both_in JOIN reps x ON x.class_id = left_id JOIN reps y ON y.class_id = right_id WHERE common / (x.n + y.n - common) >= 0.8""")
def near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of document classes that share four fifths of their five-word shingles."""
    pairs, _ = similarity.jaccard_pairs(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))
    return pairs.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_SETS} SELECT doc_id AS record_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM every")
def document_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the smallest document of the same shingles."""
    return similarity.jaccard_pairs(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))[1]


@query(f"""WITH RECURSIVE pairs AS (SELECT DISTINCT lower({_t('left_example_id')}) AS a, lower({_t('right_example_id')}) AS b FROM near_duplicate_pairs WHERE similarity >= 0.92 AND right_example_id IS NOT NULL),
good AS (SELECT * FROM pairs WHERE a <> '' AND b <> '' AND a <> b), both_ways AS (SELECT a, b FROM good UNION SELECT b, a FROM good),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen), labels AS (SELECT node, min(seen) AS label FROM reach GROUP BY 1)
SELECT (SELECT count(*) FROM (SELECT DISTINCT least(a, b), greatest(a, b) FROM good)) AS near_pairs, count(DISTINCT label) AS near_groups, count(*) AS members FROM labels""")
def near_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct near pairs, the groups they form, and the examples in them."""
    pairs = table(spark, folder, "near_duplicate_pairs").where("similarity >= 0.92").select(ids.name_id(F.col("left_example_id")).alias("a"), ids.name_id(F.col("right_example_id")).alias("b")).where("a <> b")
    pairs = Workspace(spark, "pairs").save(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    labels = connected_components(pairs).agg(F.count_distinct("label").alias("near_groups"), F.count("*").alias("members"))
    return pairs.agg(F.count("*").alias("near_pairs")).crossJoin(F.broadcast(labels))


# -- groups and splits ---------------------------------------------------------------------------------------------------------------

_GROUPS = f"""ex AS (SELECT DISTINCT {_EX} AS e, lower({_t('thread_id')}) AS t, {_FORM} AS f FROM support_examples),
near AS (SELECT lower({_t('left_example_id')}) AS a, lower({_t('right_example_id')}) AS b FROM near_duplicate_pairs WHERE similarity >= 0.92),
e0 AS (SELECT e AS a, min(e) OVER (PARTITION BY t) AS b FROM ex WHERE t <> '' UNION SELECT e, min(e) OVER (PARTITION BY f) FROM ex WHERE f <> ''
  UNION SELECT a, b FROM near WHERE a IN (SELECT e FROM ex) AND b IN (SELECT e FROM ex)),
both_ways AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0 UNION SELECT e, e FROM ex),
spread AS (SELECT a AS node, min(b) AS label, 0 AS i FROM both_ways GROUP BY a UNION ALL
  SELECT node, min(label) AS label, i FROM (SELECT w1.a AS node, w.label, w.i + 1 AS i FROM both_ways w1 JOIN spread w ON w.node = w1.b WHERE w.i < 60) GROUP BY node, i),
grouped AS (SELECT node AS example_id, label AS group_id FROM spread WHERE i = 60)"""

_CHRONO = f"""{_GROUPS},
iv AS (SELECT {_EX} AS record_id, group_id, content_start_at_utc AS s, content_end_at_utc AS x FROM support_examples JOIN grouped ON grouped.example_id = {_EX}),
ends AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS n FROM iv WHERE s IS NOT NULL AND x IS NOT NULL),
places AS (SELECT least(n - 2, greatest(1, CAST(floor(n * 0.7) AS BIGINT))) AS i1, n FROM (SELECT DISTINCT n FROM ends)),
places2 AS (SELECT i1, least(n - 1, greatest(i1 + 1, CAST(floor(n * 0.85) AS BIGINT))) AS i2 FROM places),
cut AS (SELECT min(x) AS c1, max(x) AS c2 FROM ends, places2 WHERE r = i1 OR r = i2),
g AS (SELECT group_id, min(s) AS gs, max(x) AS ge, bool_or(s IS NULL OR x IS NULL) AS bad FROM iv GROUP BY group_id),
named AS (SELECT group_id, CASE WHEN bad THEN 'quarantine' WHEN ge < c1 THEN 'train' WHEN gs >= c1 AND ge < c2 THEN 'development' WHEN gs >= c2 THEN 'test' ELSE 'quarantine' END AS split,
  CASE WHEN bad THEN 'group_contains_unusable_timestamp' WHEN ge < c1 OR (gs >= c1 AND ge < c2) OR gs >= c2 THEN NULL ELSE 'group_spans_chronological_cutoff' END AS reason FROM g, cut)"""


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, group_id`` by common thread, common text and near-duplicate pairs of at least 0.92."""
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("e"), ids.name_id(F.col("thread_id")).alias("t"), text.duplicate_form(F.col("customer_text_normalized")).alias("f"))
    rows = Workspace(spark, "groups").save(rows)
    star = lambda k: rows.where(F.col(k) != "").join(rows.where(F.col(k) != "").groupBy(k).agg(F.min("e").alias("_low")), k).select(F.col("e").alias("src"), F.col("_low").alias("dst"))
    known = rows.select("e").distinct()
    near = table(spark, folder, "near_duplicate_pairs").where("similarity >= 0.92").select(ids.name_id(F.col("left_example_id")).alias("src"), ids.name_id(F.col("right_example_id")).alias("dst"))
    near = near.join(known.withColumnRenamed("e", "src"), "src", "left_semi").join(known.withColumnRenamed("e", "dst"), "dst", "left_semi").select("src", "dst")
    own = known.select(F.col("e").alias("src"), F.col("e").alias("dst"))
    return connected_components(star("t").unionByName(star("f")).unionByName(near).unionByName(own)).select(F.col("node").alias("record_id"), F.col("label").alias("group_id"))


def _intervals(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("record_id"), "content_start_at_utc", "content_end_at_utc")
    rows = rows.join(_groups(spark, folder), "record_id")
    return Workspace(spark, "intervals").save(splitting.intervals(rows, F.col("record_id"), F.col("group_id"), F.col("content_start_at_utc"), F.col("content_end_at_utc")))


@query(f"WITH RECURSIVE {_GROUPS} SELECT example_id AS record_id, group_id FROM grouped")
def combined_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Examples joined by thread, equal text or near-duplicate pairs."""
    return _groups(spark, folder)


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, count(*) AS n FROM grouped GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def largest_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest groups."""
    return _groups(spark, folder).groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_id").limit(10)


@query(f"WITH RECURSIVE {_GROUPS}, sizes AS (SELECT count(*) AS n FROM grouped GROUP BY group_id) SELECT count(*) AS groups, max(n) AS largest, count(*) FILTER (WHERE n > 100) AS above_100, count(*) FILTER (WHERE n > 1) AS shared FROM sizes")
def group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Number and sizes of groups."""
    n = _groups(spark, folder).groupBy("group_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.count_if(F.col("n") > 100).alias("above_100"), F.count_if(F.col("n") > 1).alias("shared"))


@query(f"WITH RECURSIVE {_CHRONO} SELECT split, CAST(epoch_us(min(s)) AS VARCHAR) AS first_us, CAST(epoch_us(max(x)) AS VARCHAR) AS last_us FROM iv JOIN named USING (group_id) GROUP BY 1")
def split_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """First and last time of every split."""
    rows = _intervals(spark, folder)
    named = splitting.chronological(rows).select("group_id", "split").distinct()
    per = rows.join(named, "group_id").groupBy("split").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    return per.select("split", F.unix_micros("a").cast("string").alias("first_us"), F.unix_micros("b").cast("string").alias("last_us"))


@query(f"WITH RECURSIVE {_CHRONO} SELECT epoch_us(c1) AS train_cutoff_us, epoch_us(c2) AS test_cutoff_us FROM cut")
def split_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """The two times that separate the splits."""
    out = splitting.cutoffs(_intervals(spark, folder), 0.7, 0.15)
    return out.select(F.unix_micros("train_cutoff").alias("train_cutoff_us"), F.unix_micros("test_cutoff").alias("test_cutoff_us"))


@query(f"WITH RECURSIVE {_CHRONO} SELECT DISTINCT record_id, group_id, split, reason FROM iv JOIN named USING (group_id)")
def chronological_split(spark: SparkSession, folder: str) -> DataFrame:
    """Whole groups in train, development or test by time, quarantined where they span a cutoff."""
    return splitting.chronological(_intervals(spark, folder)).distinct()


@query(f"WITH RECURSIVE {_CHRONO} SELECT split, count(DISTINCT record_id) AS records, count(DISTINCT group_id) AS groups FROM iv JOIN named USING (group_id) GROUP BY split")
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return chronological_split(spark, folder).groupBy("split").agg(F.count_distinct("record_id").alias("records"), F.count_distinct("group_id").alias("groups"))


@query(f"""WITH RECURSIVE {_CHRONO}, pool AS (SELECT DISTINCT split, record_id, group_id, lower({_t('thread_id')}) AS thread_id, s, x FROM support_examples JOIN iv ON iv.record_id = {_EX} JOIN named USING (group_id) WHERE split <> 'quarantine'),
bounds AS (SELECT max(x) FILTER (WHERE split = 'train') AS te, min(s) FILTER (WHERE split = 'development') AS ds, max(x) FILTER (WHERE split = 'development') AS de, min(s) FILTER (WHERE split = 'test') AS ts FROM pool)
SELECT 'record_id_disjoint' AS "check", count(*) AS violations FROM (SELECT record_id FROM pool GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'group_id_disjoint', count(*) FROM (SELECT group_id FROM pool GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'thread_id_disjoint', count(*) FROM (SELECT thread_id FROM pool WHERE thread_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'strict_chronology', CAST(coalesce(CAST(te >= ds AS INTEGER), 0) + coalesce(CAST(de >= ts AS INTEGER), 0) AS BIGINT) FROM bounds""")
def leakage_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Records, groups and threads in more than one split, and touching periods; all zero passes."""
    split = chronological_split(spark, folder).where("split <> 'quarantine'").select("record_id", "group_id", "split")
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("record_id"), F.lower(ids.stripped(F.col("thread_id"))).alias("thread_id"), F.col("content_start_at_utc").alias("s"), F.col("content_end_at_utc").alias("x"))
    pool = Workspace(spark, "pool").save(rows.join(split, "record_id"))
    return splitting.overlaps(pool, "split", "record_id", "group_id", "thread_id").unionByName(splitting.chronology(pool, "split", "s", "x", ["train", "development", "test"]))


# -- samples -----------------------------------------------------------------------------------------------------------------------

_POOL = f"""{_GROUPS},
pool AS (SELECT {_EX} AS example_id, group_id, customer_text_normalized AS text, len(context_tweet_ids) AS c FROM support_examples JOIN grouped ON grouped.example_id = {_EX}
  QUALIFY row_number() OVER (PARTITION BY {_EX} ORDER BY customer_text_normalized, len(context_tweet_ids)) = 1)"""


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    """One row per example with its group: ``example_id, group_id, text, context``."""
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id"), F.col("customer_text_normalized").alias("text"), F.col("context_tweet_ids").alias("context"))
    one = F.row_number().over(Window.partitionBy("example_id").orderBy("text", F.size("context")))
    rows = rows.withColumn("_n", one).where("_n = 1").drop("_n")
    return Workspace(spark, "pool").save(rows.join(_groups(spark, folder).withColumnRenamed("record_id", "example_id"), "example_id"))


def _sql_ranked(name: str, source: str, namespace: str) -> str:
    return f"""{name} AS (SELECT *, sha256('{SEED}|{namespace}|' || example_id) AS h FROM {source} QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY sha256('{SEED}|{namespace}|' || example_id), example_id) = 1)"""


@query(f"WITH RECURSIVE {_POOL}, {_sql_ranked('r', 'pool', 'development:uniform')} SELECT CAST(row_number() OVER (ORDER BY h, example_id) AS INTEGER) AS position, example_id, group_id FROM r ORDER BY h LIMIT 80")
def uniform_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The first 80 groups by hash."""
    return sampling.uniform(_pool(spark, folder), 80, SEED, "development:uniform").withColumn("position", F.col("position").cast("int"))


@query(f"""WITH RECURSIVE {_POOL}, {_sql_ranked('r', 'pool', 'development:uniform')}, q AS (SELECT row_number() OVER (ORDER BY h, example_id) AS position, example_id, group_id FROM r ORDER BY h LIMIT 80),
fresh AS (SELECT * FROM pool WHERE group_id NOT IN (SELECT group_id FROM q)), {_sql_ranked('m', 'fresh', 'extension')}
SELECT CAST(position AS INTEGER) AS position, example_id, group_id FROM q UNION ALL SELECT CAST(80 + row_number() OVER (ORDER BY h, example_id) AS INTEGER), example_id, group_id FROM (SELECT * FROM m ORDER BY h LIMIT 20)""")
def extended_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The uniform queue with 20 more records of new groups."""
    pool = _pool(spark, folder)
    first = sampling.uniform(pool, 80, SEED, "development:uniform")
    return sampling.extend(first, pool, 20, SEED, "extension").withColumn("position", F.col("position").cast("int"))


@query()
def stratified_queue(spark: SparkSession, folder: str) -> DataFrame:
    """300 records over the coverage buckets."""
    return sampling.stratified(_pool(spark, folder), 300, SEED)


@query()
def challenge_queue(spark: SparkSession, folder: str) -> DataFrame:
    """150 random and 50 challenge records of different groups."""
    return sampling.challenge(_pool(spark, folder), 150, 50, SEED)


@query("SELECT DISTINCT " + _EX + f" AS example_id, sha256('{SEED}:' || {_EX}) AS h FROM support_examples ORDER BY h LIMIT 200")
def discovery_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The 200 examples first by discovery hash."""
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id")).distinct()
    return rows.withColumn("h", hashing.discovery_hash(SEED, F.col("example_id"))).orderBy("h").limit(200)


_BUCKET_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(customer_text_normalized), '{p}') THEN '{n}'" for n, p in sampling.COVERAGE) + f" WHEN length(trim(customer_text_normalized)) <= {sampling.SHORT} OR len(context_tweet_ids) < 1 THEN 'short_or_context_limited' ELSE 'general' END"


@query(f"SELECT {_BUCKET_SQL} AS bucket, count(*) AS n FROM support_examples GROUP BY 1")
def coverage_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Examples per coverage bucket."""
    return table(spark, folder, "support_examples").groupBy(sampling.bucket(F.col("customer_text_normalized"), F.col("context_tweet_ids")).alias("bucket")).agg(F.count("*").alias("n"))


@query(rf"""SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(trim(t)) <= {sampling.SHORT} THEN 'very_short_message' END, CASE WHEN len(context_tweet_ids) < 1 THEN 'missing_preceding_context' END,
  CASE WHEN length(t) - length(replace(t, '?', '')) >= 2 THEN 'multiple_question_clauses' END, CASE WHEN regexp_matches(t, '{sampling.SECURITY_WORDING}') THEN 'security_related_wording' END,
  CASE WHEN regexp_matches(t, '{sampling.DISPUTE_WORDING}') THEN 'account_specific_payment_dispute_wording' END], lambda x: x IS NOT NULL)) AS flag FROM (SELECT lower(trim(customer_text_normalized)) AS t, context_tweet_ids FROM support_examples)) GROUP BY 1""")
def challenge_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Examples per challenge flag."""
    return table(spark, folder, "support_examples").select(F.explode(sampling.challenge_flags(F.col("customer_text_normalized"), F.col("context_tweet_ids"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("""SELECT queue_name, sampling_stratum, count(*) AS n, count(DISTINCT example_id) AS examples, min(queue_position) AS first, max(queue_position) AS last, count(DISTINCT candidate_pool_sha256) AS pools, count(DISTINCT seed) AS seeds FROM annotation_queue GROUP BY 1, 2""")
def queue_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes and provenance of every queue by stratum."""
    return table(spark, folder, "annotation_queue").groupBy("queue_name", "sampling_stratum").agg(
        F.count("*").alias("n"), F.count_distinct("example_id").alias("examples"), F.min("queue_position").alias("first"), F.max("queue_position").alias("last"), F.count_distinct("candidate_pool_sha256").alias("pools"), F.count_distinct("seed").alias("seeds")
    )


@query(f"""WITH q AS (SELECT queue_name, queue_position AS p, lower({_t('example_id')}) AS e FROM annotation_queue), per AS (SELECT queue_name, count(*) AS n, count(DISTINCT p) AS places, min(p) AS lo, max(p) AS hi, count(DISTINCT e) AS es FROM q GROUP BY 1)
SELECT queue_name, n - es AS repeated_examples, (CASE WHEN lo = 1 AND hi = n AND places = n THEN 0 ELSE 1 END) AS broken_positions,
  (SELECT count(*) FROM q WHERE q.queue_name = per.queue_name AND e NOT IN (SELECT {_EX} FROM support_examples)) AS unknown_examples FROM per""")
def queue_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per queue: repeated examples, gaps in the positions, examples that the pool does not hold."""
    q = table(spark, folder, "annotation_queue").select("queue_name", F.col("queue_position").alias("p"), ids.name_id(F.col("example_id")).alias("e"))
    known = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("e")).distinct().withColumn("_known", F.lit(True))
    per = q.join(known, "e", "left").groupBy("queue_name").agg(F.count("*").alias("n"), F.count_distinct("p").alias("places"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.count_distinct("e").alias("es"), F.count_if(F.col("_known").isNull()).alias("unknown_examples"))
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("places") == F.col("n"))
    return per.select("queue_name", (F.col("n") - F.col("es")).alias("repeated_examples"), F.when(whole, 0).otherwise(1).alias("broken_positions"), "unknown_examples")


# -- search ------------------------------------------------------------------------------------------------------------------------

_TFIDF = r"""words AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]{2,}') AS w FROM documents WHERE text IS NOT NULL),
terms AS (SELECT id, unnest(w) AS term FROM words UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) >= 2)),
counts AS (SELECT id, term, count(*) AS n FROM terms GROUP BY 1, 2),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY 1),
raw AS (SELECT id, term, (1 + ln(n)) * idf AS w FROM counts JOIN idf USING (term)),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
weights AS (SELECT id, term, w / norm AS weight FROM raw JOIN norms USING (id))"""


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", F.col("author_id").alias("group_id"))


@query(f"WITH {_TFIDF} SELECT id, count(*) AS terms, round(sum(weight), 5) AS total, round(max(weight), 6) AS heaviest FROM weights GROUP BY 1")
def tfidf_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Number, sum and maximum of the TF-IDF weights of every document."""
    _, w = retrieval.fit(_corpus(spark, folder).select("id", "text"))
    return w.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("heaviest"))


@query(f"""WITH {_TFIDF}, grp AS (SELECT doc_id AS id, author_id AS g FROM documents),
scores AS (SELECT q.id AS query_id, d.id, round(sum(q.weight * d.weight), 8) AS score FROM weights q JOIN weights d USING (term) JOIN grp a ON a.id = q.id JOIN grp b ON b.id = d.id
  WHERE q.id % 50 = 0 AND (a.g IS NULL OR b.g IS NULL OR a.g <> b.g) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scores WHERE score > 0)
SELECT query_id, id, CAST(r AS INTEGER) AS rank, round(score, 5) AS score FROM top WHERE r <= 3""")
def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    """For every document whose id is divisible by 50, the three nearest of other authors and their scores."""
    rows = Workspace(spark, "corpus").save(_corpus(spark, folder))
    idf, w = retrieval.fit(rows.select("id", "text"))
    w = w.join(rows.select("id", "group_id"), "id")
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "text", "group_id")
    out = retrieval.lexical_topk(w, queries, idf, 3)
    return out.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.round("score", 5).alias("score"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, list_cosine_similarity(q.v, d.v) AS score FROM e q, e d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.2) SELECT query_id, id, CAST(r AS INTEGER) AS rank, round(score, 5) AS score FROM top WHERE r <= 3""")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """For every vector whose id is divisible by 50, the three of highest cosine, at least 0.2."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = retrieval.dense_topk(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), 3, 0.2)
    return out.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.round("score", 5).alias("score"))


# -- labels and evaluation ---------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS label, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def majority_class(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent class, the smallest among ties."""
    return labels.majority(table(spark, folder, "events"), "event_type")


@query("SELECT event_type AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    total = rows.agg(F.count("*").alias("t"))
    return rows.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query()
def logistic_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes that a logistic regression over the embeddings gives their own vectors, against the true ones."""
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, folder, "embeddings").where("label is not null").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    model = labels.logistic(rows)
    return model.transform(rows).groupBy(F.col("label").cast("int").alias("truth")).agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("correct"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of every key in the log; later lines win."""
    return labels.latest(table(spark, folder, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


_LOG = "log AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + (event_id % 97 = 0)::INTEGER AS INTEGER) AS attempt, event_type = 'purchase' AS ok FROM events)"


@query(f"""WITH {_LOG}, seen AS (SELECT *, row_number() OVER w AS n, coalesce(max(ok::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM log WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN done = 1 THEN 'after_success' ELSE 'not_contiguous' END AS violation FROM seen WHERE done = 1 OR attempt <> n""")
def attempt_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts out of sequence, and anything after a success, in a log made of the events."""
    rows = rank_within(table(spark, folder, "events"), "user_id", [F.col("event_id")], "n")
    log = rows.select("user_id", "event_id", "event_type", (F.col("n") + (F.col("event_id") % 97 == 0).cast("int")).alias("attempt"))
    return labels.attempt_violations(log, "user_id", "attempt", F.col("event_type") == "purchase", "event_id")


@query("""SELECT user_id, event_id, CAST(event_id % 3 AS INTEGER) AS source FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) = 1""")
def selected_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label per key by priority of its source, then the earliest."""
    rows = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_id") % 3).cast("int").alias("source"))
    return labels.prioritised(rows, "user_id", "source", "event_id")


@query("""SELECT event_id, count(*) OVER m AS requests_minute, CAST(sum(c) OVER m AS BIGINT) AS cost_minute, count(*) OVER d AS requests_day, CAST(sum(c) OVER d AS BIGINT) AS cost_day
FROM (SELECT event_id, user_id, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) AS c FROM events)
WINDOW m AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def rolling_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Requests and cost of the minute and the day before each event, per key."""
    rows = table(spark, folder, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.floor(F.col("value") * 100).alias("c"))
    return labels.rolling(rows, "user_id", "us", "c", {"minute": 60, "day": 86400}).select("event_id", "requests_minute", "cost_minute", "requests_day", "cost_day")


_JUDGED = """judged AS (SELECT event_id, event_type AS truth, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS predicted,
  CASE WHEN event_id % 5 < 4 THEN event_type = 'error' END AS should, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IN ('error', 'purchase') AS proposed FROM events)"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a key's class from its event before, beside the true class."""
    rows = Workspace(spark, "judged").save(rank_within(table(spark, folder, "events").select("user_id", "event_id", "event_type"), "user_id", [F.col("event_id")], "n"))
    before = rows.select("user_id", (F.col("n") + 1).alias("n"), F.col("event_type").alias("predicted"))
    rows = rows.join(before, ["user_id", "n"], "left").select("event_id", F.col("event_type").alias("truth"), "predicted")
    return rows.withColumn("should", F.when(F.col("event_id") % 5 < 4, F.col("truth") == "error")).withColumn("proposed", F.col("predicted").isin("error", "purchase"))


@query(f"WITH {_JUDGED} SELECT count(truth) AS labelled, count(*) FILTER (WHERE truth = predicted) AS correct, round(count(*) FILTER (WHERE truth = predicted) / count(truth), 6) AS accuracy FROM judged")
def intent_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return labels.intent_metrics(_judged(spark, folder))


@query(f"""WITH {_JUDGED}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE should) AS cases, count(*) FILTER (WHERE NOT should) AS others, count(*) FILTER (WHERE proposed) AS proposed, count(*) FILTER (WHERE NOT proposed) AS kept,
  count(*) FILTER (WHERE should AND proposed) AS hit, count(*) FILTER (WHERE should AND NOT proposed) AS missed, count(*) FILTER (WHERE NOT should AND NOT proposed) AS right_kept FROM judged)
SELECT *, coalesce(round(hit / nullif(proposed, 0), 6), 0.0) AS precision, coalesce(round(hit / nullif(cases, 0), 6), 0.0) AS recall, coalesce(round(kept / nullif(total, 0), 6), 0.0) AS coverage, coalesce(round(missed / nullif(kept, 0), 6), 0.0) AS unsafe_rate, coalesce(round(missed / nullif(cases, 0), 6), 0.0) AS missed_rate FROM c""")
def escalation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return labels.escalation_metrics(_judged(spark, folder))


@query(f"WITH {_JUDGED} SELECT truth, predicted, count(*) AS n FROM judged WHERE predicted IS NULL OR truth <> predicted GROUP BY 1, 2")
def mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong predictions by true and predicted class."""
    return _judged(spark, folder).where("predicted is null or truth <> predicted").groupBy("truth", "predicted").agg(F.count("*").alias("n"))


# -- expressions over whole tables ---------------------------------------------------------------------------------------------------


@query(rf"""SELECT source_record, substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[{_W}.+-]+@[{_W}.-]+\.[A-Za-z]{{2,}}', '[EMAIL]', 'g'), 'https?://\S+|www\.\S+', '[URL]', 'g'),
  '(^|[^{_W}])@[A-Za-z0-9_]+', '\1[USER]', 'g'), '(^|[^{_W}])\+?\d[\d\s\p{{Z}}().-]{{7,}}\d(\b)', '\1[PHONE]', 'g'), '\b\d{{6,}}\b', '[NUMBER]', 'g'), 1, 500) AS text FROM records""")
def audit_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Message texts as audit excerpts show them."""
    return table(spark, folder, "records").select("source_record", text.audit_redacted(F.col("text")).alias("text"))


@query(f"""SELECT DISTINCT {_EX} AS example_id, 'example_' || substring(sha256({_EX}), 1, 16) AS stable_id, sha256('{SEED}|training|' || {_EX}) AS rank,
  'context_' || substring(sha256(array_to_string(list_sort(context_tweet_ids), chr(0))), 1, 16) AS context_id FROM support_examples""")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Stable ids of examples and of their contexts, and hash ranks."""
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id"), "context_tweet_ids").distinct()
    return rows.select("example_id", hashing.stable_id("example", F.array("example_id")).alias("stable_id"), hashing.rank_hash(SEED, "training", F.col("example_id")).alias("rank"), hashing.stable_id("context", F.col("context_tweet_ids")).alias("context_id")).distinct()


@query(f"""WITH t AS (SELECT {_EX} AS example_id, list_append(context_created_at_utc, customer_created_at_utc) AS ts, content_start_at_utc AS s FROM support_examples)
SELECT example_id, CAST(epoch_us(CASE WHEN len(list_filter(ts, lambda x: x IS NULL)) = 0 THEN list_min(ts) END) AS VARCHAR) AS first_us, len(ts) AS times, len(list_filter(ts, lambda x: x IS NULL)) AS unreadable FROM t""")
def example_times(spark: SparkSession, folder: str) -> DataFrame:
    """First of all times of an example, null if any is missing, and how many are."""
    all_times = F.concat("context_created_at_utc", F.array("customer_created_at_utc"))
    gone = F.size(F.filter(all_times, lambda x: x.isNull()))
    return table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id"), F.when(gone == 0, F.unix_micros(F.array_min(all_times))).cast("string").alias("first_us"), F.size(all_times).cast("bigint").alias("times"), gone.cast("bigint").alias("unreadable"))


@query(f"""SELECT {_EX} AS example_id, CAST(unnest(range(1, len(context_tweet_ids) + 1)) AS INTEGER) AS pos, unnest(context_tweet_ids) AS tweet_id, unnest(context_author_ids) AS author_id, unnest(context_inbound) AS inbound FROM support_examples""")
def context_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The parallel arrays of every context as rows."""
    zipped = F.arrays_zip("context_tweet_ids", "context_author_ids", "context_inbound")
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("example_id"), F.posexplode(zipped).alias("_p", "c"))
    return rows.select("example_id", (F.col("_p") + 1).alias("pos"), F.col("c.context_tweet_ids").alias("tweet_id"), F.col("c.context_author_ids").alias("author_id"), F.col("c.context_inbound").alias("inbound"))


@query(f"""SELECT flag, count(*) AS n, count(DISTINCT e) AS examples FROM (SELECT {_EX} AS e, unnest(quality_flags) AS flag FROM support_examples) GROUP BY flag""")
def quality_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram of the quality flags of examples."""
    rows = table(spark, folder, "support_examples").select(ids.name_id(F.col("example_id")).alias("e"), F.explode("quality_flags").alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("e").alias("examples"))


@query("""SELECT count(DISTINCT form) AS texts, count(DISTINCT form) FILTER (WHERE copies > 1) AS exact_groups, CAST(coalesce(sum(copies) FILTER (WHERE copies > 1), 0) AS BIGINT) AS in_exact_groups,
  CAST(coalesce(sum(copies) FILTER (WHERE length(form) < 24), 0) AS BIGINT) AS too_short FROM forms""".join([f"WITH {_FORMS} ", ""]))
def duplicate_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct texts, exact groups, their members, and examples too short for near matching."""
    rows = _forms(spark, folder)
    return rows.agg(
        F.count("*").alias("texts"), F.count_if(F.col("copies") > 1).alias("exact_groups"), F.coalesce(F.sum(F.when(F.col("copies") > 1, F.col("copies"))), F.lit(0)).alias("in_exact_groups"),
        F.coalesce(F.sum(F.when(F.length("form") < 24, F.col("copies"))), F.lit(0)).alias("too_short"),
    )


@query(r"""SELECT doc_id, len(list_distinct(w)) AS words FROM (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(strip_accents(text)), '\[[A-Z_]+\]', ' ', 'g'), '\s+', ' ', 'g'), '[\p{L}\p{N}_]{2,}') AS w FROM documents WHERE text IS NOT NULL)""")
def plain_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct words of every document without accents."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", text.unaccented(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size(F.array_distinct(retrieval.terms(F.col("t"), 1))).cast("bigint").alias("words"))
