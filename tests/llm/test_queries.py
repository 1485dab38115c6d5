"""Every query of the llm package, against its SQL where it has one, else by what must hold of its rows."""

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from threadloom.llm import catalog, pii

Q = catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, folder, name):
    compare(spark, folder, name, Q[name], catalog.SQL[name])


def test_every_query_is_tested():
    held = set("p1_splits p1_shares p5_found p5_redacted p5_redacted_examples p7_corrected p7_rejected p8_report p9_mixture p9_shares p10_found p10_kinds p10_clean".split())
    assert set(Q) - set(catalog.SQL) == held


def test_splits(spark, folder):
    splits = Q["p1_splits"](spark, folder)
    assert splits.groupBy("unit_id").agg(F.count_distinct("split").alias("n")).where("n <> 1").count() == 0
    shares = Q["p1_shares"](spark, folder).collect()
    assert sum(r.examples for r in shares) == splits.count() and abs(sum(r.share for r in shares) - 1) < 0.001 and len(shares) == 3


def test_personal_data(spark, folder):
    found = Q["p5_found"](spark, folder)
    assert {r.kind for r in found.select("kind").distinct().collect()} == set(pii.KINDS) and found.count() == found.distinct().count()
    clean, records = Q["p5_redacted"](spark, folder), spark.read.parquet(f"{folder}/records.parquet")
    both = records.select("source_record", F.col("text").alias("raw")).join(clean, "source_record")
    assert clean.count() == records.count() and both.where("(raw is null) <> (text is null)").count() == 0
    marked = {r.row_key for r in found.where("src_table = 'records' and kind = 'email'").collect()}
    shown = {str(r.source_record) for r in both.where("instr(text, '[EMAIL]') > 0 and (raw is null or instr(raw, '[EMAIL]') = 0)").collect()}
    assert shown <= marked and len(marked - shown) <= 2
    examples = Q["p5_redacted_examples"](spark, folder)
    assert examples.count() == spark.read.parquet(f"{folder}/support_examples.parquet").count() and examples.where("instr(customer_text_normalized, '[PHONE]') > 0").count() > 0


def test_conversations(spark, folder):
    stated, corrected, rejected = (Q[n](spark, folder) for n in ("p7_found", "p7_corrected", "p7_rejected"))
    whole = stated.select("conversation_id").distinct().count()
    kept = corrected.select("conversation_id").distinct()
    assert kept.count() + rejected.count() == whole and kept.join(stated, "conversation_id", "left_anti").count() == 0
    contradictions = Q["p7_contradictions"](spark, folder).count()
    assert rejected.where("reason = 'contradicts itself'").count() == contradictions


def test_leaks(spark, folder):
    report = Q["p8_report"](spark, folder)
    verbatim = {(r.doc_id, r.item_id) for r in report.where("verbatim_windows > 0").collect()}
    assert verbatim == {(r.doc_id, r.item_id) for r in Q["p8_found"](spark, folder).collect()} and verbatim


def test_mixture(spark, folder):
    targets = {r.source: r for r in spark.read.parquet(f"{folder}/mixture_targets.parquet").collect()}
    uses = Q["p9_mixture"](spark, folder)
    rows = uses.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and len({(r.doc_id, r.use) for r in rows}) == len(rows)
    shares = Q["p9_shares"](spark, folder).collect()
    assert len(shares) == len(targets) and sum(r.uses for r in shares) == len(rows)
    live = sum(r.target_share for r in shares if r.tokens)
    for r in shares:
        assert r.most_uses <= next(t.max_repeats for s, t in targets.items() if s.lower().replace(" ", "_").replace("-", "_") == r.source)
        # Within half a document of the target.
        assert not r.tokens or abs(r.actual_share - r.target_share / live) < 0.1


def test_residue(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id for r in Q["p10_found"](spark, folder).collect()}
    kinds = Q["p10_kinds"](spark, folder)
    assert found == {r.doc_id for r in kinds.collect()} and kinds.where("not (has_blank or has_filler or is_page)").count() == 0
    assert found | {r.doc_id for r in Q["p10_clean"](spark, folder).collect()} == {r.doc_id for r in documents.select("doc_id").collect()} and found
