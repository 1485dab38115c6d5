"""Positions and running totals within groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.workspace import Workspace, temporary_name


def running_totals(df: DataFrame, group: str, order: Sequence[Column], values: Mapping[str, Column], partitions: int | None = None, largest: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` with, for each name, the sum of its value over the rows of the group up to and with this one by ``order``; for each name of
    ``largest``, the greatest value instead, null before the first one that is not null.

    Rows are range partitioned by group and order, summed within their slice, and shifted by the sums (or greatest values) of the group's earlier slices.
    A group may exceed any task: its rows spread over as many slices as it needs, and only groups that cross a slice boundary, at
    most one per boundary, enter the table of shifts. Rows equal in ``order`` follow one another in any order; nulls in a value
    count nothing; a null group is a group; columns called as the names give way. Empty input gives an empty result.
    """
    work = Workspace(df.sparkSession, "ranking")
    largest = largest or {}
    names = [*values, *largest]
    df = df.drop(*names)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece, in_group, in_piece = (temporary_name(df.columns, x) for x in ("_slice", "_group", "_piece"))
    own, amount, shift = ({v: temporary_name(df.columns, f"{x}{i}") for i, v in enumerate(names)} for x in ("_own", "_amount", "_shift"))
    keys = [temporary_name(df.columns, f"_o{i}") for i in range(len(order))]
    sliced = df.select("*", *[F.coalesce(c, F.lit(0)).alias(amount[v]) for v, c in values.items()], *[c.alias(amount[v]) for v, c in largest.items()], *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    sliced = work.save(sliced.repartitionByRange(n, F.col(group), *[F.col(k) for k in keys]).withColumn(piece, F.spark_partition_id()))
    fold = {v: F.sum if v in values else F.max for v in names}
    sizes = sliced.groupBy(F.col(group).alias(in_group), F.col(piece).alias(in_piece)).agg(*[fold[v](amount[v]).alias(shift[v]) for v in names])
    spread = Window.partitionBy(in_group)
    # One row per group and slice; groups of one slice go before anything is broadcast.
    crossing = sizes.withColumn("_n", F.count("*").over(spread)).where("_n > 1")
    earlier = spread.orderBy(in_piece).rowsBetween(Window.unboundedPreceding, -1)
    shifts = work.save(crossing.select(in_group, in_piece, *[fold[v](shift[v]).over(earlier).alias(shift[v]) for v in names]))
    within = Window.partitionBy(piece, group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.select("*", *[fold[v](amount[v]).over(within).alias(own[v]) for v in names])
    # The table of shifts has at most two rows per slice.
    moved = summed.join(F.broadcast(shifts), F.col(group).eqNullSafe(F.col(in_group)) & (F.col(piece) == F.col(in_piece)), "left")
    return moved.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(own[v]) + F.coalesce(shift[v], F.lit(0)) if v in values else F.greatest(own[v], shift[v])).alias(v) for v in names])


def running_total(df: DataFrame, group: str, order: Sequence[Column], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """:func:`running_totals` of one value."""
    return running_totals(df, group, order, {name: value}, partitions)


def rank_within(df: DataFrame, group: str, order: Sequence[Column], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``, the position from 1 of every row within its group by ``order``; as :func:`running_total` of ones."""
    ranked = running_total(df, group, order, F.lit(1), name, partitions)
    return ranked.withColumn(name, F.col(name).cast("int"))
