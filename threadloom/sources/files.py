"""Readers and writers for message dumps, event logs and content-addressed documents."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")


def read_messages_csv(spark: SparkSession, path: str | list[str], required: Sequence[str] = MESSAGE_COLUMNS, header_from: str | None = None) -> DataFrame:
    """All-string columns of a CSV dump with quoted line breaks, blank where empty, and ``source_record``: row number plus 2.

    The header must name the required columns; what lacks is listed sorted. Other columns are not read. Row numbers follow the
    file order: partition offsets are counted first, then added, so no row passes through one task.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "")
    have = reader.csv(path, inferSchema=False).columns
    lacking = sorted(set(required) - set(have))
    if lacking:
        raise ValueError("missing required columns: " + ", ".join(lacking))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in have])
    rows = reader.schema(schema).csv(path).select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in required])
    numbered = rows.withColumn("_m", F.monotonically_increasing_id())
    pid = F.shiftright("_m", 33)
    sizes = numbered.groupBy(pid.alias("p")).count().orderBy("p").collect()  # one row per input partition
    before, offsets = 2, []
    for r in sizes:
        offsets.append((r["p"], before))
        before += r["count"]
    table = spark.createDataFrame(offsets, "_p long, _b long")
    out = numbered.withColumn("_p", pid).join(F.broadcast(table), "_p")
    return out.select((F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b")).alias("source_record"), *required)


def read_labels_csv(spark: SparkSession, path: str, blank_to_null: Sequence[str], key: str = "example_id") -> DataFrame:
    """A label table of strings; blanks of the named columns are null; an id that comes twice is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in blank_to_null:
        rows = rows.withColumn(c, F.nullif(F.trim(c), F.lit("")))
    twice = rows.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError("duplicate ids: " + ", ".join(str(r[0]) for r in twice))
    return rows


def read_strict_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; any line that does not fit ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_last_json(spark: SparkSession, path: str, key: Column, order: Column, skip: Column | None = None) -> DataFrame:
    """The last JSON line of each key as ``key, line``; blank lines and those that ``skip`` matches do not count.

    ``key``, ``order`` and ``skip`` are expressions over ``line``.
    """
    rows = spark.read.text(path).withColumnRenamed("value", "line").where(F.trim("line") != "")
    if skip is not None:
        rows = rows.where(~F.coalesce(skip, F.lit(False)))
    return rows.select(key.alias("key"), order.alias("_o"), "line").groupBy("key").agg(F.max_by("line", "_o").alias("line"))


def read_where_in(spark: SparkSession, path: str, key: str, wanted: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the rows whose key is in a list, pushed to the Parquet scan; an absent or repeated key is an error."""
    rows = spark.read.parquet(path).where(F.col(key).isin(list(wanted))).select(key, *[c for c in columns if c != key])
    n, distinct = rows.agg(F.count("*"), F.count_distinct(key)).first()
    if n != distinct or distinct != len(set(wanted)):
        raise ValueError(f"expected {len(set(wanted))} unique rows, found {n} rows of {distinct} keys")
    return rows


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, wherever it is, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file, whole or not at all; False if there is one already. Nothing is ever replaced."""
    fs, final = _fs(spark, path)
    _, aside = _fs(spark, f"{final.getParent()}/.{final.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        return False
    return True


def _get(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _versions(spark: SparkSession, folder: str, pointer: str) -> list[int]:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(int(n.rsplit("-", 1)[1]) for n in (x.getPath().getName() for x in fs.listStatus(p)) if re.fullmatch(rf"{re.escape(pointer)}-\d+", n))


def write_replacing(df: DataFrame, folder: str, pointer: str = "CURRENT", columns: Sequence[str] | None = None) -> str:
    """Writes a table beside the old one, then creates the next of numbered pointers: readers see the one or the other, never a part or none.

    ``columns`` fixes the columns and their order. A second writer that is first makes this one fail; the older pointer goes last.
    """
    spark, name = df.sparkSession, f"data-{uuid.uuid4().hex}"
    (df.select(*columns) if columns else df).write.parquet(f"{folder}/{name}")
    done = _versions(spark, folder, pointer)
    number = (done[-1] if done else 0) + 1
    if not _put(spark, f"{folder}/{pointer}-{number}", name):
        raise RuntimeError(f"another writer replaced {folder}")
    for old in done[:-1]:
        fs, p = _fs(spark, f"{folder}/{pointer}-{old}")
        fs.delete(p, False)
    return f"{folder}/{name}"


def read_current(spark: SparkSession, folder: str, pointer: str = "CURRENT") -> DataFrame:
    done = _versions(spark, folder, pointer)
    if not done:
        raise FileNotFoundError(f"no {pointer} in {folder}")
    return spark.read.parquet(f"{folder}/{_get(spark, f'{folder}/{pointer}-{done[-1]}')}")


def write_fixed(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A Parquet table of exactly these columns, in this order; a missing one is an error."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError("missing columns: " + ", ".join(sorted(lacking)))
    df.select(*[F.col(f"`{c}`") for c in columns]).write.parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """Adds JSON lines to a log; null fields are kept."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, UTF-8."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_addressed(spark: SparkSession, folder: str, value: object) -> str:
    """Writes a document under the digest of its canonical form; the same document is written once, other bytes never replace it."""
    text = canonical_json(value) + "\n"
    path = f"{folder.rstrip('/')}/{digest(value)}.json"
    if not _put(spark, path, text) and _get(spark, path) != text:
        raise ValueError(f"other bytes under {path}")
    return path


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the bytes of one file, read in pieces."""
    fs, p = _fs(spark, path)
    stream, h = fs.open(p), hashlib.sha256()
    try:
        size, at = fs.getFileStatus(p).getLen(), 0
        buffer = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        while at < size:
            piece = buffer.toByteArray(stream, int(min(1 << 24, size - at)))
            h.update(piece)
            at += len(piece)
    finally:
        stream.close()
    return h.hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, digest`` of every file below a path, one task per file; files up to 2 GB."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("digest"))


@contextmanager
def run_lock(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds a lock file while a block runs; an error if another run holds it. A run that died leaves its file, for a person to remove."""
    if not _put(spark, path, uuid.uuid4().hex):
        raise RuntimeError(f"{path} is held by another run")
    try:
        yield
    finally:
        fs, p = _fs(spark, path)
        fs.delete(p, False)


def sections(text: str, wanted: Sequence[str]) -> str:
    """The sections of a guide, split at ``## ``, whose titles are wanted, in the order asked for; one that lacks is an error."""
    found = {}
    for part in re.split(r"(?m)^## ", text)[1:]:
        title, _, body = part.partition("\n")
        found[title.strip()] = body.strip()
    lacking = [w for w in wanted if w not in found]
    if lacking:
        raise ValueError("missing sections: " + ", ".join(lacking))
    return "\n\n".join(f"## {w}\n{found[w]}" for w in wanted)


def json_list(c: Column) -> Column:
    """A JSON list of strings; null, blank and unreadable text read as the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def flat_record(df: DataFrame, lists: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """A record table as CSV keeps it: lists as JSON in ``<name>_json``, flags as true or false, null as blank."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in lists:
            columns.append(F.to_json(F.coalesce(c, F.array().cast(kind))).alias(f"{name}_json"))
        elif name in flags:
            columns.append(F.when(F.coalesce(c, F.lit(False)), "true").otherwise("false").alias(name))
        else:
            columns.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(*columns)


def nested_record(df: DataFrame, schema: T.StructType, lists: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """The inverse of :func:`flat_record` for a schema: blank is null, lists are never null; a value that does not fit its type is null."""
    columns = []
    for f in schema.fields:
        if f.name in lists:
            columns.append(F.coalesce(F.from_json(F.col(f"`{f.name}_json`"), f.dataType), F.array().cast(f.dataType)).alias(f.name))
        elif f.name in flags:
            columns.append((F.lower(f"`{f.name}`") == "true").alias(f.name))
        else:
            columns.append(F.nullif(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType).alias(f.name))
    return df.select(*columns)


def content_digest(df: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order and files: count and sums of two row hashes."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    total = df.select(F.xxhash64(row).cast("decimal(38,0)").alias("a"), F.xxhash64(row, F.lit(1)).cast("decimal(38,0)").alias("b")).agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256("|".join(map(str, total)).encode()).hexdigest()
