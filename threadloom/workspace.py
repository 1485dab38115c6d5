"""Intermediate tables that cut lineage and outlive a lost executor.

Iterative operators write each round as Parquet below the folder named by ``spark.checkpoint.dir``, which every executor can
reach. A written table has real size statistics, so the planner can choose a broadcast by measured size, and it is compressed,
unlike an RDD checkpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; a temporary one only where none is named and all executors are on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        named = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_scopes: list[list[Workspace]] = []


class Workspace:
    """A folder of written intermediate tables for one call of an operator.

    ``save`` writes and reads back; ``drop`` deletes tables that no later plan reads. What is left, at most the tables behind
    the returned DataFrame, goes when the :func:`scope` it was made in or the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)
        if _scopes:
            _scopes[-1].append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` as written and read back."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        # A given schema saves the job that would infer it.
        back = self.spark.read.schema(df.schema).parquet(path)
        back._threadloom_path = path
        return back

    def save_and_count(self, df: DataFrame, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
        """``save``, and how many rows meet each condition, observed while they are written instead of by another job.

        A stage that runs again after a loss may observe rows twice: good for telling none from some.
        """
        seen = Observation()
        back = self.save(df.observe(seen, *[F.count_if(c).alias(k) for k, c in conditions.items()]))
        return back, seen.get

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}"

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_threadloom_path", None)
            if path:
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the JVM may be gone when the process ends
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A written table is estimated by its compressed size; in memory it may be this many times larger.
COMPRESSION = 8


def fits(df: DataFrame, limit_bytes: int) -> bool:
    """Whether ``df`` is within a limit in memory, by the planner's size estimate times :data:`COMPRESSION`: the check before any broadcast."""
    return stored_bytes(df) * COMPRESSION <= limit_bytes


def stored_bytes(df: DataFrame) -> int:
    """The planner's size estimate: of a written table, its compressed size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def scope() -> Iterator[None]:
    """Deletes, when the block ends, all intermediate tables of operators called in it; what they returned must be written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for work in _scopes.pop():
            work.clear()
            atexit.unregister(work.clear)


def temporary_name(taken: list[str], wanted: str) -> str:
    """A column name not in use, whatever case the others have."""
    used = {x.lower() for x in taken}
    name = wanted
    while name.lower() in used:
        name = f"_{name}"
    return name
