"""A keyed store for messages that were delivered at least once.

Rows live in runs: bucketed Parquet tables whose files are sorted by identifier, the bucket being the hash of the identifier. An upsert
writes one run to a folder of its own and never reads what is there, so delivering a batch again only adds copies that lose again.
Compaction merges the sorted runs two by two, bucket by bucket, by a merge join that needs neither a shuffle nor a sort of its inputs, so
equal identifiers meet and collapse to one.

Which runs count is told by the newest of numbered pointer files. A pointer is created once, after its runs are whole, and never
changed; a folder that no pointer names, left by a job that died, is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

KEY, ORDER = "store_key", "store_order"
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class KeyedStore:
    """Exactly one row of each identifier, the one of smallest precedence, whatever the deliveries and their order.

    ``folder`` must be one that all executors reach. Payload names may not be ``store_key`` or ``store_order``. One writer at a time: a second
    one fails to create its pointer, and nothing it wrote counts.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, buckets: int):
        clash = sorted({f.name.lower() for f in schema} & {KEY, ORDER})
        if clash:
            raise ValueError(f"reserved column names: {', '.join(clash)}")
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets
        self.tables: dict[str, str] = {}

    def upsert(self, df: DataFrame, key: Column, order: Column) -> None:
        """Adds a run. Copies within the batch collapse before the shuffle; rows without a key are left out.

        The rank limit runs on both sides of the exchange, so a key that holds a third of the rows moves once per input task.
        """
        rows = df.select(key.alias(KEY), order.alias(ORDER), *[F.col(f"`{f.name}`") for f in self.schema]).where(F.col(KEY).isNotNull())
        version, runs = self._current()
        self._point(version + 1, [*runs, self._write(_first_of_each(rows))])

    def compact(self) -> None:
        """Merges all runs into one, two neighbours at a time, and moves the pointer; only then the old runs and pointers go."""
        version, runs = self._current()
        if len(runs) < 2:
            return
        left, made = list(runs), []
        while len(left) > 1:
            pairs = [left[i : i + 2] for i in range(0, len(left), 2)]
            left = [p[0] if len(p) == 1 else self._write(self._merged(*p)) for p in pairs]
            made += left
        self._point(version + 1, left)
        for run in {*runs, *made} - set(left):
            self._forget(run)
        fs, path = self._fs(self.folder)
        for old in self._versions():
            if old <= version:
                fs.delete(self._fs(f"{self.folder}/_CURRENT-{old}")[1], False)

    def read(self) -> DataFrame:
        """The whole rows kept, with ``store_key`` and ``store_order``; merges what has not been compacted yet, without a shuffle for one or two runs."""
        _, runs = self._current()
        if not runs:
            return self.spark.createDataFrame([], self._full())
        out = self._run(runs[0])
        for run in runs[1:]:
            out = _collapsed(out, self._run(run))
        return out

    def kept(self) -> DataFrame:
        """As ``read``; right after ``compact`` it is a plain scan."""
        return self.read()

    def _merged(self, a: str, b: str) -> DataFrame:
        return _collapsed(self._run(a), self._run(b))

    def _write(self, rows: DataFrame) -> str:
        """Writes a run: one file per bucket, sorted by key. A task holds whole buckets, as the exchange or the merge left them."""
        run = f"run-{uuid.uuid4().hex}"
        conf, before = self.spark.conf, self.spark.conf.get(_SORTED_SCANS)
        # A file that is one whole bucket may be trusted to be sorted as it was written.
        conf.set(_SORTED_SCANS, "true")
        try:
            rows.write.insertInto(self._table(run))
        finally:
            conf.set(_SORTED_SCANS, before)
        return run

    def _run(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def _table(self, run: str) -> str:
        if run not in self.tables:
            name = f"threadloom_store_{uuid.uuid4().hex}"
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._full())
            self.spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
            self.tables[run] = name
        return self.tables[run]

    def _forget(self, run: str) -> None:
        name = self.tables.pop(run, None)
        if name:
            self.spark.sql(f"DROP TABLE {name}")
        fs, path = self._fs(f"{self.folder}/{run}")
        fs.delete(path, True)

    def _full(self) -> T.StructType:
        return T.StructType([T.StructField(KEY, T.LongType()), T.StructField(ORDER, T.LongType()), *self.schema.fields])

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, path = self._fs(self.folder)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removeprefix("_CURRENT-")) for n in names if n.startswith("_CURRENT-"))

    def _current(self) -> tuple[int, list[str]]:
        """The newest version and its runs; 0 and none for a new store."""
        versions = self._versions()
        if not versions:
            return 0, []
        fs, path = self._fs(f"{self.folder}/_CURRENT-{versions[-1]}")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return versions[-1], text.split()

    def _point(self, version: int, runs: list[str]) -> None:
        """Creates the pointer of a version: written aside, then renamed, which fails if another writer was first."""
        fs, path = self._fs(f"{self.folder}/_CURRENT-{version}")
        _, aside = self._fs(f"{self.folder}/.pointer-{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray("\n".join(runs).encode()))
        stream.close()
        if fs.exists(path) or not fs.rename(aside, path):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer made version {version} of {self.folder}")


def _first_of_each(rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(ORDER))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _collapsed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs with one row per key each, merged by key; the row of smaller order stays, the earlier run's where both are equal."""
    names = [c for c in a.columns if c != KEY]
    l, r = a.select(F.col(KEY), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_l")), b.select(F.col(KEY), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_r"))
    both = l.join(r.hint("merge"), KEY, "full")
    pick = F.when(F.col("_r").isNull() | (F.col("_l").isNotNull() & F.coalesce(F.col(f"_l.{ORDER}") <= F.col(f"_r.{ORDER}"), F.col(f"_l.{ORDER}").isNull())), F.col("_l")).otherwise(F.col("_r"))
    return both.select(KEY, pick.alias("_row")).select(KEY, *[F.col("_row").getField(c).alias(c) for c in names])
