"""Problem 1: train, validation and test splits that keep related records together."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import connected_components
from threadloom.operators.ranking import rank_within, running_total
from threadloom.workspace import Workspace


def units(records: DataFrame, record: Column, keys: Sequence[Column], time: Column | None = None) -> DataFrame:
    """``record_id, unit_id, ends`` with one row per distinct record.

    Records are joined, directly or through others, by an equal non-null key of the same kind; a record that comes several times,
    with different keys, belongs to all of them. ``unit_id`` is the smallest key of the first kind that the unit holds; a record
    without any key is a unit named by its own id. ``ends`` is the latest time of the record, null if it has none. Rows
    without a record id are left out.

    The graph is on keys, not records: its edges are the distinct key pairs that records state, so a key shared by a third of
    all rows is one node.
    """
    work = Workspace(records.sparkSession, "units")
    tagged = F.array_compact(F.array(*[F.when(k.isNotNull(), F.concat(F.lit(f"{i}"), k)) for i, k in enumerate(keys)]))
    rows = records.select(record.alias("record_id"), tagged.alias("_keys"), (time if time is not None else F.lit(None).cast("timestamp")).alias("_time")).where("record_id is not null")
    rows = work.save(rows)  # ids are put in plain form once
    stated = rows.where("size(_keys) > 0").select("record_id", F.array_min("_keys").alias("_low"), "_keys", "_time")
    # Two rows of one record are tied through the record's smallest key.
    per = work.save(rows.groupBy("record_id").agg(F.min(F.array_min("_keys")).alias("_key"), F.max("_time").alias("ends"), F.count_if(F.size("_keys") > 0).alias("_n")))
    within = stated.select("_low", F.explode("_keys").alias("_other")).where("_low <> _other").distinct()
    own = stated.select("_low", F.col("_low").alias("_other")).distinct()
    tied = stated.select("record_id", "_low").join(per.where("_n > 1").select("record_id", "_key"), "record_id").where("_low <> _key").select("_low", F.col("_key").alias("_other")).distinct()
    labels = connected_components(within.unionByName(own).unionByName(tied), "_low", "_other").select(F.col("node").alias("_key"), F.col("label").alias("_unit"))
    return per.join(labels, "_key", "left").select("record_id", F.coalesce(F.substring("_unit", 2, 1 << 20), "record_id").alias("unit_id"), "ends")


def difference(weights: Sequence[float], bins: int) -> list[int]:
    """The bin of each weight by largest differencing, into ``bins`` bins of near equal sums.

    Every weight starts as a tuple of bins of which one is filled. The two tuples of widest spread are combined, the heaviest bin of
    one with the lightest of the other, until one tuple is left.
    """
    if not len(weights):
        return []
    heap: list[tuple] = []
    for i, w in enumerate(weights):
        heap.append((-w, i, [0.0] * (bins - 1) + [float(w)], [[] for _ in range(bins - 1)] + [[i]]))
    heapq.heapify(heap)
    tick = len(weights)
    while len(heap) > 1:
        _, _, s1, m1 = heapq.heappop(heap)
        _, _, s2, m2 = heapq.heappop(heap)
        merged = []
        for a, b, x, y in zip(s1, reversed(s2), m1, reversed(m2), strict=True):
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            merged.append((a + b, x))
        merged.sort(key=lambda p: p[0])
        sums = [p[0] for p in merged]
        heapq.heappush(heap, (sums[0] - sums[-1], tick, sums, [p[1] for p in merged]))
        tick += 1
    out = [0] * len(weights)
    for b, members in enumerate(heap[0][3]):
        for i in members:
            out[i] = b
    return out


def assign_splits(unit_rows: DataFrame, shares: dict[str, float], bins: int = 64, chunk: int = 1024) -> DataFrame:
    """``record_id, unit_id, split`` with every unit whole in one split, splits near their shares, earlier units first.

    Units are laid out by their latest time (none: first) and their id, and cut by exact rank into chunks of ``chunk`` units; largest
    differencing packs each chunk into ``bins`` bins of near equal weight, and whole bins go to the splits in the order of ``shares``, each
    to the split that holds the middle of the bin on the line of cumulated weight. A unit heavier than a bin of its chunk stays whole:
    differencing gives it a bin of its own, and whatever it takes beyond the share of a split is taken from the next.
    Units too heavy for the split where time would put them, more than a quarter of the smallest split, go to the split with the most room
    first.

    The result depends on nothing but the rows: not on their partitions, their order or the number of tasks. Tasks hold one chunk of unit
    weights; ranks and cumulated weights are taken over range slices, never in one task.
    """
    spark = unit_rows.sparkSession
    work = Workspace(spark, "splits")
    weights = work.save(unit_rows.groupBy("unit_id").agg(F.count("*").alias("weight"), F.max("ends").alias("ends")))
    total, n, heaviest = weights.agg(F.sum("weight"), F.count("*"), F.max("weight")).first()
    names, goal = list(shares), sum(shares.values())
    if not n:
        return unit_rows.select("record_id", "unit_id", F.lit(None).cast("string").alias("split"))
    room = {k: total * v / goal for k, v in shares.items()}
    # Fewer than 4 / smallest share units can weigh a quarter of the smallest split: a bounded list.
    limit = total * min(shares.values()) / goal / 4
    fixed: list[tuple[str, str]] = []
    if heaviest > limit:
        for r in weights.where(F.col("weight") > limit).orderBy(F.desc("weight"), "unit_id").collect():
            to = max(names, key=lambda k: room[k])
            room[to] -= r["weight"]
            fixed.append((r["unit_id"], to))
    rest = weights.where(F.col("weight") <= limit).withColumn("all", F.lit(1))
    ranked = rank_within(rest, "all", [F.col("ends"), F.col("unit_id")], "_rank")
    placed = ranked.select("unit_id", "weight", F.floor((F.col("_rank") - 1) / chunk).alias("chunk"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["weight", "unit_id"], ascending=[False, True], ignore_index=True)
        return frame.assign(bin=difference(frame["weight"].tolist(), bins)).astype({"bin": "int32"})

    packed = work.save(placed.groupBy("chunk").applyInPandas(pack, "unit_id string, weight long, chunk long, bin int"))
    sizes = packed.groupBy("chunk", "bin").agg(F.sum("weight").alias("weight")).withColumn("all", F.lit(1))
    summed = running_total(sizes, "all", [F.col("chunk"), F.col("bin")], F.col("weight"), "_upto")
    middle = summed.select("chunk", "bin", (F.col("_upto") - F.col("weight") / 2).alias("_mid"))
    left = max(1e-9, sum(max(0.0, x) for x in room.values()))
    free = rest.agg(F.sum("weight")).first()[0] or 0
    edge = 0.0
    choice = F.lit(names[-1])
    edges = []
    for k in names:
        edge += max(0.0, room[k]) / left * free
        edges.append((k, edge))
    for k, e in reversed(edges[:-1]):
        choice = F.when(F.col("_mid") <= e, F.lit(k)).otherwise(choice)
    by_bin = middle.select("chunk", "bin", choice.alias("split"))
    by_unit = packed.join(by_bin, ["chunk", "bin"]).select("unit_id", "split")
    if fixed:
        by_unit = by_unit.unionByName(spark.createDataFrame(fixed, "unit_id string, split string"))
    return unit_rows.join(by_unit, "unit_id").select("record_id", "unit_id", "split")


def split_checks(assigned: DataFrame, shares: dict[str, float], tolerance: float = 0.02) -> DataFrame:
    """``check, n``: records and units, and how many of them stand in two splits or in none, and splits whose share is off by more than ``tolerance``."""
    per = assigned.groupBy("unit_id").agg(F.count_distinct("split").alias("splits"), F.count_distinct("record_id").alias("records"), F.count_if(F.col("split").isNull()).alias("bare"))
    counts = per.agg(F.sum("records").alias("records"), F.count("*").alias("units"), F.count_if(F.col("splits") > 1).alias("units_in_two_splits"), F.count_if(F.col("bare") > 0).alias("units_without_split"))
    # One row per split.
    sizes = assigned.groupBy("split").agg(F.count_distinct("record_id").alias("_n"))
    goal = sum(shares.values())
    wanted = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v / goal))])
    total = sizes.agg(F.sum("_n").alias("_all"))
    off = sizes.crossJoin(F.broadcast(total)).agg(F.count_if(F.abs(F.col("_n") / F.col("_all") - F.coalesce(wanted[F.col("split")], F.lit(0.0))) > tolerance).alias("shares_off"))
    every = counts.crossJoin(F.broadcast(off))
    named = [F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n")) for c in ("records", "units", "units_in_two_splits", "units_without_split", "shares_off")]
    return every.select(F.inline(F.array(*named)))
