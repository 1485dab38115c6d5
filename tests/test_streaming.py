"""A stream of deliveries."""

from pyspark.sql import functions as F

from threadloom.operators.store import KeyedStore
from threadloom.streaming.deliveries import upsert_stream
from threadloom.workspace import Workspace


def test_stream_into_store(spark, tmp_path):
    schema = "o long, k long, text string"
    parts = [[(1, 1, "a"), (2, 2, "b")], [(1, 1, "a"), (3, 1, "z")], [(0, 2, "first"), (9, 9, None), (10, None, "x")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.json(str(tmp_path / "in" / f"batch={i}"))
    rows = spark.createDataFrame([], schema)
    store = KeyedStore(spark, Workspace(spark, "test").path(), rows.select("text").schema, 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    seen = []
    for folder in ("one", "two"):  # the second run delivers everything again
        upsert_stream(stream, store, F.col("k"), F.col("o"), str(tmp_path / folder), compact_every=2, after=seen.append, once=True).awaitTermination()
    assert len(seen) >= 6
    assert sorted((r.store_key, r.store_order, r.text) for r in store.read().collect()) == [(1, 1, "a"), (2, 0, "first"), (9, 9, None)]
