"""Problem 3: pairwise matches consolidated into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import connected_components


def consolidate(pairs: DataFrame, left: Column, right: Column, known: DataFrame, record: Column) -> DataFrame:
    """``record_id, group_id`` of every known record that some pair links to another; ``group_id`` is the smallest id of its group.

    Minimum labels travel across the pairs, pointer jumping shortens the chains, and every round is written to the shared
    folder until no label changes (:func:`threadloom.operators.graph.connected_components`).

    Pairs with a missing side, self pairs and pairs that name an unknown record link nothing; repeated and turned-round pairs
    count once. ``known`` may repeat records. Empty input gives an empty result.
    """
    edges = pairs.select(left.alias("a"), right.alias("b")).where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    ids = known.select(record.alias("src")).where("src is not null").distinct()
    edges = edges.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
    found = connected_components(edges)
    return found.select(F.col("node").alias("record_id"), F.col("label").alias("group_id"))
