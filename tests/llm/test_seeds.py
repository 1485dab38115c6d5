"""The labelled tables share no runs of words with the tables they are used on."""

import re

from pyspark.sql import functions as F

from threadloom.llm import pii_seeds, residue_seeds

RUN = 7


def runs(text):
    w = ["0" if x.isdigit() else x for x in re.findall(r"[^\W_]+", text.lower())]
    for i in range(len(w) - RUN + 1):
        # Fewer different words are a phrase said again and again.
        if len(set(w[i : i + RUN])) >= 5:
            yield " ".join(w[i : i + RUN])


def test_no_runs_of_words_in_common(spark, folder):
    latin = set(runs(residue_seeds.LATIN))
    texts = residue_seeds.FILLER + residue_seeds.NOTICE + residue_seeds.PROSE + residue_seeds.REPORTS + residue_seeds.UNFILLED + residue_seeds.QUOTED
    texts += [re.sub(r"\{d\d+\}", " 0 ", t) for t in pii_seeds.PLAIN] + [t for c in (pii_seeds.CARRIERS, pii_seeds.ID_CARRIERS) for ts in c.values() for t in ts]
    seeds = {r for t in texts for r in runs(t)} - latin
    assert len(seeds) > 1000
    columns = [("documents", "text"), ("records", "text"), ("support_examples", "customer_text_normalized"), ("benchmark", "text")]
    for name, column in columns:
        rows = spark.read.parquet(f"{folder}/{name}.parquet").select(F.col(column)).where(F.col(column).isNotNull())
        for (text,) in rows.toLocalIterator():
            assert not seeds & set(runs(text)), text
