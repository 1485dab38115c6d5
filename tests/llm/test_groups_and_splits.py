"""Consolidated groups and splits of related records."""

import datetime as dt
import random

from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.llm.groups import consolidate
from threadloom.llm.splits import assign_splits, difference, units

SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def test_consolidate(spark):
    pairs = [("A ", "b"), ("b", "a"), ("b", "c"), ("c", "C"), ("d", None), ("d", "unknown"), ("x", "y"), (None, None), ("z", "z")]
    known = [(k,) for k in ("a", "A", "b", "c", "d", "x", "Y", "z", None)]
    p = spark.createDataFrame(pairs, "l string, r string").withColumn("group_id", F.lit(1))
    k = spark.createDataFrame(known, "e string").withColumn("node", F.lit("n"))
    got = consolidate(p, ids.name_id(F.col("l")), ids.name_id(F.col("r")), k, ids.name_id(F.col("e")))
    assert {(x.record_id, x.group_id) for x in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert consolidate(p.limit(0), F.col("l"), F.col("r"), k, F.col("e")).count() == 0
    assert consolidate(p, F.col("l"), F.col("r"), k.limit(0), F.col("e")).count() == 0


def test_units(spark):
    rows = [("e1", "g1", "t1"), ("e2", None, "T1 "), ("e3", "g2", "t2"), ("e3", "g1", None), ("e4", None, None), ("e5", "", "t9"), ("e6", None, "t9"), (None, "g1", "t1"), ("e1", "g1", "t1")]
    df = spark.createDataFrame(rows, "e string, g string, t string").withColumn("record_id", F.lit(0)).withColumn("_keys", F.lit(0))
    got = {x.record_id: x.unit_id for x in units(df, ids.name_id(F.col("e")), [ids.name_id(F.col("g")), ids.name_id(F.col("t"))]).collect()}
    assert got == {"e1": "g1", "e2": "g1", "e3": "g1", "e4": "e4", "e5": "t9", "e6": "t9"}
    assert units(df.limit(0), F.col("e"), [F.col("g")]).count() == 0


def test_differencing_balances():
    r = random.Random(4)
    for n in (1, 7, 500):
        w = [r.choice([1, 1, 1, 2, 3, 9]) for _ in range(n)]
        bins = difference(w, 8)
        sums = [sum(x for x, b in zip(w, bins, strict=True) if b == k) for k in range(8)]
        assert sum(sums) == sum(w) and max(sums) - min(sums) <= (1 if n == 500 else max(w))
    assert difference([], 4) == [] and difference([8, 7, 6, 5, 4], 2).count(0) in (2, 3)


def split_rows(spark, giant=0):
    r = random.Random(5)
    day = dt.datetime(2023, 1, 1)
    rows = [(f"r{i}-{k}", f"u{i:05d}", day + dt.timedelta(hours=i)) for i in range(3000) for k in range(r.choice([1, 1, 2, 4]))]
    rows += [(f"n{i}", f"n{i}", None) for i in range(20)] + [(f"big{i}", "big", day) for i in range(giant)]
    return spark.createDataFrame(rows, "record_id string, unit_id string, ends timestamp")


def check_split(rows, got, tolerance):
    total = rows.count()
    per = {x.split: x["count"] for x in got.groupBy("split").count().collect()}
    assert got.count() == total and got.groupBy("unit_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    for k, v in SHARES.items():
        assert abs(per[k] / total - v) < tolerance, per
    return per


def test_splits_are_near_their_shares_and_in_time(spark):
    rows = split_rows(spark)
    got = assign_splits(rows, SHARES)
    check_split(rows, got, 0.01)
    middle = {x.split: x.m for x in got.join(rows, ["record_id", "unit_id"]).groupBy("split").agg(F.avg(F.col("ends").cast("long")).alias("m")).collect()}
    assert middle["train"] < middle["validation"] < middle["test"]


def test_a_unit_of_a_third_stays_whole(spark):
    rows = split_rows(spark, giant=3000)
    got = assign_splits(rows, SHARES)
    check_split(rows, got, 0.02)
    assert {x.split for x in got.where("unit_id = 'big'").distinct().collect()} == {"train"}


def test_empty_and_tiny(spark):
    rows = split_rows(spark)
    assert assign_splits(rows.limit(0), SHARES).count() == 0
    assert assign_splits(rows.where("unit_id = 'u00001'"), SHARES).select("split").distinct().count() == 1


def test_splits_do_not_depend_on_partitions(spark):
    ids = spark.range(400000).select(F.concat(F.lit("r"), "id").alias("record_id"), F.concat(F.lit("u"), F.floor(F.col("id") / 3)).alias("unit_id"), F.timestamp_seconds(F.col("id") * 37 % 100003).alias("ends"))
    first = assign_splits(ids, SHARES)
    second = assign_splits(ids.repartition(7, "ends"), SHARES)
    other = second.withColumnRenamed("split", "_split")
    assert first.join(other, ["record_id", "unit_id"]).where("split = _split").count() == 400000
