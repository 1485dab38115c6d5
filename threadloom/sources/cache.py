"""Vectors that are worked out once for a contract and checked whenever they are read."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources import files


def cached_vectors(spark: SparkSession, folder: str, contract: Mapping[str, object], build: Callable[[], DataFrame], tolerance: float = 1e-5) -> tuple[DataFrame, bool]:
    """``id, vector`` for a contract (digests of texts and ids, model, renderer), and whether they came from the cache.

    A table is named by the digest of its contract, so another contract is another table. On reading, the saved contract, a digest of the rows
    and the length of every vector are checked; what does not fit is an error, and nothing is overwritten. The note that makes a table
    count is written last and once: a build that died leaves a folder that is never read.
    """
    key = files.digest(dict(contract))
    note = f"{folder.rstrip('/')}/{key}.json"
    fs, p = files._fs(spark, note)
    hit = bool(fs.exists(p))
    if not hit:
        rows = build().select("id", "vector")
        path = files.write_replacing(rows, f"{folder.rstrip('/')}/{key}", columns=["id", "vector"])
        saved = spark.read.parquet(path)
        files._put(spark, note, files.canonical_json({"contract": dict(contract), "path": path, "rows": files.content_digest(saved)}) + "\n")
    said = json.loads(files._get(spark, note))
    rows = spark.read.parquet(said["path"])
    if said["contract"] != json.loads(files.canonical_json(dict(contract))) or said["rows"] != files.content_digest(rows):
        raise ValueError(f"the cache {note} does not hold what its contract says")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bad = rows.agg(F.count_if(~F.coalesce(F.abs(norm - 1) <= tolerance, F.lit(False))).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} vectors in {note} are not of length one")
    return rows, hit
