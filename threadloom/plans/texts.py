"""Queries of the texts that models read, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids, text
from threadloom.operators import extraction, retrieval
from threadloom.plans.pipeline import _EX, _EXAMPLES, _W, _members, _messages, AUTHOR
from threadloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A host whose links the queries keep by name, a parameter of the expression.
SAFE = ("tuneharbor.example",)


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a function under its name, with its SQL if it has one."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _sql_redacted(value: str, safe: tuple[str, ...] = ()) -> str:
    """Redaction of one SQL expression, without handles of brands."""
    out = f"regexp_replace({value}, '(?i)[{_W}.+-]+@[{_W}.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g')"
    if safe:
        hosts = "|".join(h.replace(".", "\\.") for h in safe)
        out = f"regexp_replace({out}, '(?i)https?://((?:[{_W}-]+\\.)*(?:{hosts}))(?::\\d+)?(?:[/?#][^\\s<>()]*?)?([.,!?;:)\\]}}]*)([\\s<>()]|$)', '[URL:\\1]\\2\\3', 'g')"
    out = f"regexp_replace({out}, '(?i)(?:https?://|www\\.)[^\\s<>()]*?([.,!?;:)\\]}}]*)([\\s<>()]|$)', '[URL]\\1\\2', 'g')"
    out = f"regexp_replace({out}, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b', '[IP]', 'g')"
    out = f"regexp_replace({out}, '(^|[^{_W}.])(?:\\+?\\d[\\d\\s().-]{{7,}}\\d)(\\b)', '\\1[PHONE]', 'g')"
    out = f"regexp_replace({out}, '(^|[^{_W}])@([A-Za-z0-9_]+)', '\\1[CUSTOMER]', 'g')"
    return f"regexp_replace({out}, '\\b\\d{{6,}}\\b', '[NUMBER]', 'g')"


def _sql_feature(value: str) -> str:
    return f"regexp_replace({_sql_redacted(value)}, '\\[[A-Z_]+\\]', ' ', 'g')"


_SAID = "coalesce(customer_text_normalized, '')"
_BEFORE = "array_to_string(coalesce(context_texts_normalized, []), ' ')"


@query(f"SELECT {_EX} AS example_id, {_sql_feature(f'trim({_BEFORE} || chr(32) || {_SAID}, chr(32))')} AS text FROM support_examples")
def feature_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Context and message of every example as the lexical models read them."""
    rows = table(spark, folder, "support_examples")
    return rows.select(ids.name_id(F.col("example_id")).alias("example_id"), text.feature_text(F.coalesce("customer_text_normalized", F.lit("")), F.col("context_texts_normalized")).alias("text"))


@query(f"SELECT {_EX} AS example_id, {_sql_feature(_SAID)} || ' ' || {_sql_feature(_BEFORE)} AS text FROM support_examples")
def dense_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Message first, then context, of every example, as an encoder reads them."""
    rows = table(spark, folder, "support_examples")
    return rows.select(ids.name_id(F.col("example_id")).alias("example_id"), text.dense_text(F.col("customer_text_normalized"), F.col("context_texts_normalized")).alias("text"))


@query(f"SELECT doc_id, {_sql_redacted('d.text', SAFE)} AS text FROM documents d WHERE text IS NOT NULL")
def safe_links(spark: SparkSession, folder: str) -> DataFrame:
    """Redacted documents that keep the host of links to safe domains."""
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", text.redacted(F.col("text"), (), SAFE).alias("text"))


@query(rf"""WITH words AS (SELECT regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}_]{{2,}}') AS w, doc_id FROM documents WHERE text IS NOT NULL),
terms AS (SELECT doc_id, unnest(w) AS term FROM words UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) >= 2)),
counts AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM terms GROUP BY 1 ORDER BY total DESC, term LIMIT 500)
SELECT term, round(ln((1 + (SELECT count(*) FROM words)) / (1 + df)) + 1, 6) AS idf FROM counts""")
def bounded_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """The 500 commonest terms of the documents without accents, with their weights."""
    rows = table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("id"), text.unaccented(F.col("text")).alias("text"))
    idf, _ = retrieval.fit(rows, 2, 500)
    return idf.select("term", F.round("idf", 6).alias("idf"))


@query(f"WITH RECURSIVE {_EXAMPLES} SELECT customer, list_reverse(c.trail[2:]) <> b.context AS turned FROM built b JOIN chain c ON c.id = b.customer WHERE len(reasons) = 0")
def turned_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the context of an example stands in another order by time than by answers."""
    m = _messages(spark, folder)
    return extraction.examples(m, _members(m), AUTHOR).where("size(reasons) = 0").select("customer", "turned")

