"""Queries of problems 5, 8, 9 and 10."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.llm.leakage import leak_report, leaked_windows
from threadloom.llm.mixture import mix, mixed_shares
from threadloom.llm.pii import personal_data, redacted
from threadloom.llm.residue import residue, without_residue
from threadloom.sources.tables import table


#: The vocabulary file of a public tokenizer that the queries count tokens with; a parameter of every operator.
TOKENIZER = os.environ.get("THREADLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_windows(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"), table(spark, folder, "benchmark"), F.col("item_id"), F.col("text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items that share ten consecutive words."""
    return _leaks(spark, folder).where("verbatim").select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Verbatim and re-parameterised windows per document and item."""
    return leak_report(_leaks(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of personal data in every text of records and of support_examples."""
    records = table(spark, folder, "records").select(F.lit("records").alias("src_table"), F.col("source_record").cast("string").alias("row_key"), F.lit("text").alias("field_name"), F.lit(0).alias("item_no"), F.col("text").alias("value"))
    examples = table(spark, folder, "support_examples").select(F.lit("support_examples").alias("src_table"), ids.name_id(F.col("example_id")).alias("row_key"), "customer_text_normalized", "context_texts_normalized")
    own = examples.select("src_table", "row_key", F.lit("customer_text_normalized").alias("field_name"), F.lit(0).alias("item_no"), F.col("customer_text_normalized").alias("value"))
    context = examples.select("src_table", "row_key", F.lit("context_texts_normalized").alias("field_name"), F.posexplode("context_texts_normalized").alias("_p", "value")).select("src_table", "row_key", "field_name", (F.col("_p") + 1).alias("item_no"), "value")
    rows = records.unionByName(own).unionByName(context)
    return personal_data(rows, F.col("value")).drop("value").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Records with placeholders in their text."""
    return redacted(table(spark, folder, "records").select("source_record", "text"), "text")


def p5_redacted_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Examples with placeholders in the message and its context."""
    return redacted(table(spark, folder, "support_examples").select("example_id", "customer_text_normalized", "context_texts_normalized"), "customer_text_normalized", "context_texts_normalized")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Training positions of the mixed documents: every use of every document."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mixture_targets"), TOKENIZER)


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of tokens of every source."""
    return mixed_shares(table(spark, folder, "documents"), table(spark, folder, "mixture_targets"), TOKENIZER)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold template residue or filler, or are nothing but an error page or a notice."""
    return residue(table(spark, folder, "documents"), F.col("doc_id"), F.col("text")).select("doc_id")


def p10_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents with the kinds of residue found."""
    return residue(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


def p10_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The remaining documents."""
    return without_residue(table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p5_found, p5_redacted, p5_redacted_examples, p8_found, p8_report, p9_mixture, p9_shares, p10_found, p10_kinds, p10_clean)}

_MARKUP = r"<!--.*?-->|</?[A-Za-z][^<>]*>|&([A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"


def _sql_windows(name: str, source: str, key: str) -> str:
    return f"""{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 9], ' ') AS passage FROM (
  SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (
    SELECT {key}, regexp_extract_all(lower(regexp_replace(text, '{_MARKUP}', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source} WHERE text IS NOT NULL) WHERE len(w) >= 10))"""


SQL = {
    "p8_found": f"WITH {_sql_windows('d', 'documents', 'doc_id')}, {_sql_windows('b', 'benchmark', 'item_id')} SELECT DISTINCT doc_id, item_id FROM d JOIN b USING (passage)",
}
