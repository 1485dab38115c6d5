"""Problem 9: sources mixed to target weights, over the course of training.

Every source has a weight schedule over training time. Its integral is the source's cumulative demand of tokens; inverted, it turns the
running total of tokens of a source into positions in training, and documents are range sorted by position.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.operators.ranking import running_total
from threadloom.workspace import Workspace, fits

#: Tables of targets beyond this size are joined by a shuffle.
TARGETS_BROADCAST_BYTES = 4 << 20


def source_name(c: Column) -> Column:
    """A source in one spelling: lower case, runs of blanks, hyphens and underscores as one underscore; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(ids.stripped(c)), r"[\s_\-]+", "_"), F.lit(""))


def count_tokens(rows: DataFrame, text: str, tokenizer: str) -> DataFrame:
    """``rows`` with ``tokens`` in place of ``text``: tokens of the whole text, 0 for null. One pass, no shuffle; equal texts of a batch are counted once."""
    names = [c for c in rows.columns if c != text]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer)
        own.encode_special_tokens = True
        for batch in batches:
            codes, texts = pd.factorize(batch[text].fillna(""))
            counts: list[int] = []
            for i in range(0, len(texts), 256):
                # Without the places of tokens in the text, which nobody asks for.
                counts += [len(e.ids) for e in own.encode_batch_fast(texts[i : i + 256].tolist(), add_special_tokens=False)]
            yield batch[names].assign(tokens=pd.Series(counts, dtype="int64").to_numpy()[codes] if len(codes) else pd.Series([], dtype="int64"))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != text)
    return rows.mapInPandas(scan, f"{schema}, tokens long")


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, ramp: float = 0.5, slopes: Mapping[str, float] | None = None) -> DataFrame:
    """One row per target source: ``source, target, available, max_repeats, demand, slope``.

    ``target`` is the share among sources that have documents. With no ``total_tokens`` the total is the largest at which every such
    source meets its target within its repeats. A larger total makes sources short: those give all their uses and the others
    share the rest by weight. ``slope`` tilts the schedule ``w(t) = share * (1 + slope * (2t - 1))``: sources that must repeat
    ramp up by ``ramp``, the others down, so that the weights add up to one at any time. ``slopes`` states the slopes of sources instead, from
    -1 (falls to nothing) to 1 (starts from nothing); sources it does not name are level.
    """
    goal = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("max_repeats"))
    goal = goal.where("source is not null and share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = goal.join(have, "source", "left").select("source", "share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available")).collect()  # one row per target
    live = {r["source"]: r for r in rows if r["available"] > 0}
    weight = sum(r["share"] for r in live.values())
    if live:
        best = min(r["available"] * r["max_repeats"] * weight / r["share"] for r in live.values())
    total = float(total_tokens) if total_tokens is not None else (best if live else 0.0)
    demand: dict[str, float] = {}
    free, left = dict(live), total
    while free:
        part = sum(r["share"] for r in free.values())
        short = [s for s, r in free.items() if left * r["share"] / part > r["available"] * r["max_repeats"] * (1 + 1e-12)]
        if not short:
            demand |= {s: left * r["share"] / part for s, r in free.items()}
            break
        for s in short:
            demand[s] = float(live[s]["available"] * live[s]["max_repeats"])
            left -= demand[s]
            del free[s]
    real = sum(demand.values()) or 1.0
    repeated = sum(d for s, d in demand.items() if d > live[s]["available"]) / real
    down = -min(1.0, ramp * repeated / (1 - repeated)) if repeated < 1 else 0.0
    up = -down * (1 - repeated) / repeated if repeated > 0 else 0.0
    def slope(source: str, available: int) -> float:
        if slopes is not None:
            return float(slopes.get(source, 0.0))
        return up if demand.get(source, 0.0) > available else down

    if slopes is not None and any(abs(v) > 1 for v in slopes.values()):
        raise ValueError("slopes lie between -1 and 1")
    out = [(r["source"], r["share"] / weight if r["source"] in live else 0.0, int(r["available"]), int(r["max_repeats"]), demand.get(r["source"], 0.0), slope(r["source"], r["available"])) for r in rows]
    return sized.sparkSession.createDataFrame(out, "source string, target double, available long, max_repeats int, demand double, slope double")


def position(done: Column, demand: Column, slope: Column) -> Column:
    """The time t at which a source with a linear schedule has asked for ``done`` of its ``demand``: solves t + slope (t² - t) = done / demand."""
    y = done / demand
    b = 1 - slope
    return F.when(F.abs(slope) < 1e-9, y).otherwise((-b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * slope * y))) / (2 * slope))


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: int | None = None, ramp: float = 0.5, seed: int = 42, slopes: Mapping[str, float] | None = None) -> DataFrame:
    """``doc_id, source, use, tokens, position``: every use of every document, range sorted by its position in training (0 to 1).

    Each source is passed over in the order of a hash, whole passes first, then a part that ends where its demand does (to half a
    document). No document is used more than ``max_repeats`` times. Documents without text or tokens, without source or of a source
    without a target are not used. Repeated rows count as documents of their own. A source may hold any share of the rows: running
    totals are taken over range slices, not by source in one task.
    """
    work = Workspace(documents.sparkSession, "mixture")
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("source is not null and text is not null")
    sized = work.save(count_tokens(rows, "text", tokenizer).where("tokens > 0"))
    planned = plan(sized, targets, total_tokens, ramp, slopes).where("demand > 0")
    if fits(planned, TARGETS_BROADCAST_BYTES):
        planned = F.broadcast(planned)
    known = sized.join(planned, "source")
    summed = running_total(known, "source", [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")], F.col("tokens"), "_upto")
    middle = F.col("_upto") - F.col("tokens") / 2
    # Uses: the passes in which the middle of the document still lies within the demand.
    passes = F.least(F.col("max_repeats"), F.floor((F.col("demand") - middle) / F.col("available")).cast("int") + 1)
    used = summed.withColumn("_passes", passes).where("_passes > 0").withColumn("use", F.explode(F.sequence(F.lit(1), F.col("_passes"))))
    done = (F.col("use") - 1) * F.col("available") + middle
    placed = used.withColumn("position", F.least(F.lit(1.0), position(done, F.col("demand"), F.col("slope"))))
    return placed.select("doc_id", "source", "use", "tokens", "position").orderBy("position", "doc_id", "use")


def mixed_shares(documents: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: int | None = None) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, uses, most_uses`` per target source, those without documents too."""
    mixed = mix(documents, targets, tokenizer, total_tokens)
    per = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"))
    per = per.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    out = goal.join(per, "source", "left").fillna(0, ["tokens", "documents", "uses", "most_uses"])
    total = out.agg(F.sum("tokens").alias("_total"))
    return out.crossJoin(F.broadcast(total)).select("source", "target_share", F.round(F.coalesce(F.try_divide(F.col("tokens"), F.col("_total")), F.lit(0.0)), 4).alias("actual_share"), "tokens", "documents", "uses", "most_uses")
