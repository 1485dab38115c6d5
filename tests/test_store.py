"""The keyed store under repeated deliveries."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators.store import KeyedStore
from threadloom.workspace import Workspace


def make(spark, df, **kw):
    return KeyedStore(spark, Workspace(spark, "test").path(), df.schema, 4, **kw)


def rows_of(df):
    return sorted((r.store_key, r.store_order, r.text) for r in df.collect())


def test_order_of_deliveries_does_not_matter(spark):
    data = [(5, 1, "a"), (3, 1, "b"), (9, 2, "c"), (4, 2, "d"), (7, None, "e"), (8, 3, None)]
    df = spark.createDataFrame(data, "o long, k long, text string").withColumn("extra", F.lit(1))
    payload = df.select("text")
    want = [(1, 3, "b"), (2, 4, "d"), (3, 8, None)]
    for batches in ([data], [data[:2], data[2:]], [data[3:], data[:4], data, data]):
        store = make(spark, payload)
        for b in batches:
            store.upsert(spark.createDataFrame(b, "o long, k long, text string").withColumn("extra", F.lit(1)), F.col("k"), F.col("o"))
        assert rows_of(store.read()) == want
        store.compact()
        assert rows_of(store.kept()) == want
        store.upsert(df, F.col("k"), F.col("o"))
        store.compact()
        assert rows_of(store.kept()) == want


def test_hot_key_and_empty(spark):
    df = spark.range(3000).select(F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.lit("t").alias("text"))
    store = make(spark, df.select("text"))
    store.upsert(df.limit(0), F.col("k"), F.col("o"))
    assert store.read().count() == 0
    store.upsert(df, F.col("k"), F.col("o"))
    store.compact()
    assert store.kept().count() == 2000 and store.kept().where("store_key = 1").first().store_order == 0


def test_a_store_is_found_again(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "o long, k long, text string")
    path = Workspace(spark, "test").path()
    store = KeyedStore(spark, path, df.select("text").schema, 4)
    store.upsert(df, F.col("k"), F.col("o"))
    store.compact()
    assert rows_of(KeyedStore(spark, path, df.select("text").schema, 4).read()) == [(1, 1, "a")]


def test_compaction_merges_without_shuffle_or_sort(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "o long, k long, text string")
    store = make(spark, df.select("text"))
    store.upsert(df, F.col("k"), F.col("o"))
    store.upsert(df, F.col("k"), F.col("o"))
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        plan = store.read()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "false")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_a_crash_at_any_step_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "o long, k long, text string")
    path, schema = Workspace(spark, "test").path(), df.select("text").schema
    store = KeyedStore(spark, path, schema, 4)
    store.upsert(df, F.col("k"), F.col("o"))
    store.upsert(df, F.col("k"), F.col("o") - 1)
    want = [(1, 0, "a"), (2, 2, "c")]
    for step in ("_point", "_forget", "_write"):

        def die(*_):
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(KeyedStore, step, die)
            broken = KeyedStore(spark, path, schema, 4)
            for job in (lambda: broken.compact(), lambda: broken.upsert(df, F.col("k"), F.col("o") + 5)):
                try:
                    job()
                except OSError:
                    pass
        again = KeyedStore(spark, path, schema, 4)
        assert rows_of(again.read()) == want
        again.compact()
        assert rows_of(again.kept()) == want
        again.upsert(df, F.col("k"), F.col("o") - 1)
        want = [(1, 0, "a"), (2, 2, "c")]
    store = KeyedStore(spark, path, schema, 4)
    store._point(store._current()[0] + 1, store._current()[1])
    with pytest.raises(RuntimeError):
        store._point(store._current()[0], [])


def test_reserved_names(spark):
    with pytest.raises(ValueError):
        make(spark, spark.createDataFrame([(1,)], "STORE_KEY int"))
