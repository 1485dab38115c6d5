"""Several values packed in one field: one row per value, with its position.

Every field is reduced to its delimiter skeleton: runs of letters and digits are masked, everything that can separate or quote is
kept. Fields by the billion share few skeletons, so the splitting rule (which digit runs make up which value) is worked out once
per distinct skeleton, joined back, and applied by position with built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.workspace import Workspace, fits

#: Rules are broadcast up to this many bytes as written; beyond, they are joined by a shuffle.
RULES_BROADCAST_BYTES = 8 << 20

_QUOTES = "\"'`«»‘’‚“”„"
_GROUPED = re.compile(r"[ST](?:,T)+")
_PIECES = re.compile(r"[^;|/&\tw\n\r；｜]+")


def masked(c: Column) -> Column:
    """The field with letters masked by ``w`` and the empty fraction of a whole number (``12.0``) by ``Z``."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}+", "w"), r"(?<=[0-9])\.0*(?![0-9])", "Z")


def skeleton(mask: Column) -> Column:
    """Digit runs by their length: ``N`` four or more, ``T`` three, ``S`` one or two; whole-number fractions stay ``Z``."""
    out = F.regexp_replace(mask, "[0-9]{4,}", "N")
    return F.regexp_replace(F.regexp_replace(out, "[0-9]{3}", "T"), "[0-9]{1,2}", "S")


def resolve(shape: str) -> list[list[int]]:
    """The values of a skeleton, each as the numbers (from 1) of the digit runs that make it up.

    A run is a value by itself unless letters touch it. Inside quotes, runs of at most three digits joined by commas, the later ones
    of exactly three, are one number. A dot between two runs makes neither a whole number, unless both are long.
    """
    number = {m.start(): i for i, m in enumerate(re.finditer("[NST]", shape), 1)}
    taken: dict[int, list[int]] = {}
    for start, end in _quoted(shape):
        for piece in _PIECES.finditer(shape, start, end):
            body = piece.group().strip("  　" + _QUOTES).removesuffix("Z")
            if _GROUPED.fullmatch(body):
                at = piece.start() + piece.group().index(body)
                places = [at + i for i, ch in enumerate(body) if ch in "ST"]
                taken |= {p: [] for p in places[1:]} | {places[0]: [number[p] for p in places]}
    out = []
    for at, n in number.items():
        if at in taken:
            if taken[at]:
                out.append(taken[at])
            continue
        before, after = shape[:at], shape[at + 1 :]
        if before.endswith("w") or re.match("Z?w", after):
            continue
        if re.match(r"\.[NST]", after) and not (shape[at] == "N" and after[1] == "N") or re.search(r"[NST]\.$", before) and not (shape[at] == "N" and before[-2] == "N"):
            continue
        out.append([n])
    return out


def _quoted(shape: str) -> list[tuple[int, int]]:
    """Stretches between quotes: each pair of neighbouring quotes, and the whole field if quotes enclose it."""
    marks = [i for i, ch in enumerate(shape) if ch in _QUOTES]
    spans = [(a + 1, b) for a, b in zip(marks, marks[1:], strict=False) if b > a + 1]
    if len(marks) == 2 or not marks:
        return spans
    bare = shape.strip()
    if bare[0] in _QUOTES and bare[-1] in _QUOTES:
        spans.append((marks[0] + 1, marks[-1]))
    return spans


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"_shape": batch["_shape"], "_rule": [resolve(x) for x in batch["_shape"]]})


def split_packed(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = (), least: int = 1) -> DataFrame:
    """``keep`` columns, ``field_name``, ``pos`` (from 1) and ``id_value`` (digits without leading zeros) of every value of every field.

    Only fields with at least ``least`` values come out. Null, empty and value-free fields give no rows; empty slots and words take
    no position; repeated values keep theirs; long fields are processed whole. Repeated rows of ``df`` repeat in the result. Other
    columns of ``df`` play no part, so their names may clash with anything. An empty table gives an empty result.
    """
    work = Workspace(df.sparkSession, "packed")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in fields]))
    rows = df.select(*keys, pairs.alias("_f")).select(*[f"_k{i}" for i in range(len(keep))], F.col("_f.name").alias("field_name"), F.col("_f.value").alias("_value"))
    # One value needs one digit, more need a digit after something else.
    rows = rows.where(F.col("_value").rlike("[0-9][^0-9]+[0-9]" if least > 1 else "[0-9]")).withColumn("_mask", masked(F.col("_value"))).drop("_value")
    rows = rows.withColumn("_shape", skeleton(F.col("_mask")))
    shapes = rows.select("_shape").distinct()
    rules = work.save(shapes.mapInPandas(_rules, "_shape string, _rule array<array<int>>").where(F.size("_rule") >= least))
    if fits(rules, RULES_BROADCAST_BYTES):
        rules = F.broadcast(rules)
    runs = rows.join(rules, "_shape").withColumn("_runs", F.regexp_extract_all("_mask", F.lit("([0-9]+)"), 1))
    values = runs.select(*[f"_k{i}" for i in range(len(keep))], "field_name", "_runs", F.posexplode("_rule").alias("_pos", "_part"))
    joined = F.array_join(F.transform("_part", lambda i: F.element_at("_runs", i)), "")
    return values.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)],
        "field_name",
        (F.col("_pos") + 1).cast("int").alias("pos"),
        F.regexp_replace(joined, "^0+(?=[0-9])", "").alias("id_value"),
    )
