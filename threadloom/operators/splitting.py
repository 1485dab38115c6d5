"""Chronological splits of whole groups, and checks that nothing leaks between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import rank_within


def intervals(df: DataFrame, record: Column, group: Column, start: Column, end: Column) -> DataFrame:
    """``record_id, group_id, start, end``; a record without a group is a group of its own."""
    return df.select(record.alias("record_id"), F.coalesce(group, record).alias("group_id"), start.alias("start"), end.alias("end")).where("record_id is not null")


def cutoffs(rows: DataFrame, train: float, development: float) -> DataFrame:
    """One row ``train_cutoff, test_cutoff``: two order statistics of the ends of records with both times, by exact rank.

    With n usable records the ranks from 0 are ``min(n - 2, max(1, floor(n train)))`` and
    ``min(n - 1, max(first + 1, floor(n (train + development))))``. Ends are ranked over range slices, not in one task. Fewer than
    three usable records give nulls, and every group is then quarantined.
    """
    usable = rows.where("start is not null and end is not null").select(F.lit(1).alias("all"), "end", F.xxhash64("record_id", "start").alias("_tie"))
    # The tie only spreads one repeated time over slices; the element at a rank is the same whatever its order.
    ranked = rank_within(usable, "all", [F.col("end"), F.col("_tie")], "rank")
    n = usable.agg(F.count("*").alias("n"))
    first = F.least(F.col("n") - 2, F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(train)))).alias("i1")
    places = n.select("n", first)
    places = places.select("i1", F.least(F.col("n") - 1, F.greatest(F.col("i1") + 1, F.floor(F.col("n") * F.lit(train + development)))).alias("i2"), "n").where("n >= 3")
    at = ranked.join(F.broadcast(places), (F.col("rank") == F.col("i1") + 1) | (F.col("rank") == F.col("i2") + 1))
    return at.agg(F.min("end").alias("train_cutoff"), F.max("end").alias("test_cutoff"))


def chronological(rows: DataFrame, train: float = 0.7, development: float = 0.15) -> DataFrame:
    """``record_id, group_id, split, reason``: groups that lie wholly within a period get its split, the others ``quarantine``.

    Train ends before the first cutoff; development starts at it or later and ends before the second; test starts at the second or
    later. A group with any unusable time is quarantined whole.
    """
    groups = rows.groupBy("group_id").agg(F.min("start").alias("gs"), F.max("end").alias("ge"), F.bool_or(F.col("start").isNull() | F.col("end").isNull()).alias("bad"))
    cut = F.broadcast(cutoffs(rows, train, development))  # one row
    split = (
        F.when(F.col("bad") | F.col("train_cutoff").isNull(), "quarantine")
        .when(F.col("ge") < F.col("train_cutoff"), "train")
        .when((F.col("gs") >= F.col("train_cutoff")) & (F.col("ge") < F.col("test_cutoff")), "development")
        .when(F.col("gs") >= F.col("test_cutoff"), "test")
        .otherwise("quarantine")
    )
    reason = F.when(F.col("bad"), "group_contains_unusable_timestamp").when(F.col("split") == "quarantine", "group_spans_chronological_cutoff")
    named = groups.crossJoin(cut).withColumn("split", split).withColumn("reason", reason).select("group_id", "split", "reason")
    return rows.select("record_id", "group_id").join(named, "group_id").select("record_id", "group_id", "split", "reason")


def overlaps(pools: DataFrame, split: str, *columns: str) -> DataFrame:
    """``check, violations``: how many values of each column occur in more than one split; arrays count by element. All zero passes."""
    out = None
    for c in columns:
        value = F.explode(c) if dict(pools.dtypes)[c].startswith("array") else F.col(c)
        per = pools.select(split, value.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count_distinct(split).alias("_n"))
        row = per.agg(F.count_if(F.col("_n") > 1).alias("violations")).select(F.lit(f"{c}_disjoint").alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def chronology(pools: DataFrame, split: str, start: str, end: str, order: list[str]) -> DataFrame:
    """One row ``check, violations``: neighbouring non-empty splits of ``order`` whose times touch or overlap."""
    per = pools.where(F.col(split).isin(order)).groupBy(split).agg(F.min(start).alias("s"), F.max(end).alias("e"))
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(split))
    # At most one row per split.
    listed = per.agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "s", "e"))).alias("l"))
    pairs = F.zip_with(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1))), lambda a, b: a["e"] >= b["s"])
    return listed.select(F.lit("strict_chronology").alias("check"), F.size(F.filter(pairs, lambda x: x)).cast("bigint").alias("violations"))
