"""Label event logs, prediction caches, rolling budgets and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import running_totals


def _best(rows: DataFrame, key: str, by: Column) -> DataFrame:
    """The row of smallest ``by`` of each key, by an aggregate that combines on the map side: a hot key is no hot task. A null key is a key."""
    one = rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), by).alias("_r"))
    return one.select(*[F.col("_r").getField(c).alias(c) for c in rows.columns])


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key by a numeric order; later lines win."""
    return _best(events, key, -F.col(order))


def attempt_violations(events: DataFrame, key: str, attempt: str, success: Column, order: str) -> DataFrame:
    """``key, order, violation``: attempts that do not follow on from the one before, and anything after a success.

    Places and earlier successes are running totals over range slices, so a key of any size is spread over tasks.
    """
    rows = events.select(key, order, F.col(attempt).alias("_a"), F.coalesce(success, F.lit(False)).cast("int").alias("_s"))
    rows = running_totals(rows, key, [F.col(order)], {"_n": F.lit(1), "_won": F.col("_s")})
    kind = F.when(F.col("_won") - F.col("_s") > 0, "after_success").when(F.col("_a") != F.col("_n"), "not_contiguous")
    return rows.withColumn("violation", kind).where("violation is not null").select(key, order, "violation")


def prioritised(labels: DataFrame, key: str, priority: str, order: str) -> DataFrame:
    """One label per key: the lowest priority number wins, then the earliest."""
    return _best(labels, key, F.struct(priority, order))


def rolling(events: DataFrame, group: str, micros: str, cost: str, windows: dict[str, int]) -> DataFrame:
    """``events`` with count and cost of the seconds before and with each event, one pair of columns per window; the lower bound is open.

    Every moment of a group enters all windows once and leaves each of them once, its length later; what is within is a running total, taken
    over range slices, so that no group has to fit a task. Rows of one moment see one another. A null time sees nothing: its sums are null.
    """
    per = events.where(F.col(micros).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(micros).alias("_t")).agg(F.count("*").alias("_n"), F.coalesce(F.sum(cost), F.lit(0)).alias("_c"))
    names = [f"{x}_{w}" for w in windows for x in ("requests", "cost")]
    zero = F.lit(0).cast("bigint")
    moves = per.select("_g", "_t", F.lit(1).alias("_enter"), *[F.col("_n" if n.startswith("requests") else "_c").cast("bigint").alias(f"_v_{n}") for n in names])
    for w, seconds in windows.items():
        out = [(-F.col("_n" if n.startswith("requests") else "_c").cast("bigint") if n.endswith(f"_{w}") else zero).alias(f"_v_{n}") for n in names]
        moves = moves.unionByName(per.select("_g", (F.col("_t") + seconds * 1_000_000).alias("_t"), F.lit(0).alias("_enter"), *out))
    held = running_totals(moves, "_g", [F.col("_t"), F.col("_enter")], {n: F.col(f"_v_{n}") for n in names}).where("_enter = 1").select("_g", "_t", *names)
    return events.join(held, F.col(group).eqNullSafe(F.col("_g")) & (F.col(micros) == F.col("_t")), "left").select(*[events[c] for c in events.columns], *names)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def intent_metrics(rows: DataFrame) -> DataFrame:
    """One row of ``labelled, correct, accuracy`` over ``truth, predicted``; rows without truth do not count."""
    out = rows.agg(F.count("truth").alias("labelled"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct"))
    return out.select("labelled", "correct", ratio(F.col("correct"), F.col("labelled")).alias("accuracy"))


def escalation_metrics(rows: DataFrame) -> DataFrame:
    """One row of the escalation confusion over ``should, proposed`` (true: escalate); null ``should`` counts only in coverage."""
    should, proposed = F.col("should"), F.col("proposed")
    out = rows.agg(
        F.count("*").alias("total"), F.count_if(should).alias("cases"), F.count_if(~should).alias("others"), F.count_if(proposed).alias("proposed"), F.count_if(~proposed).alias("kept"),
        F.count_if(should & proposed).alias("hit"), F.count_if(should & ~proposed).alias("missed"), F.count_if(~should & ~proposed).alias("right_kept"),
    )
    c = F.col
    return out.select(
        "total", "cases", "others", "proposed", "kept", "hit", "missed", "right_kept",
        ratio(c("hit"), c("proposed")).alias("precision"), ratio(c("hit"), c("cases")).alias("recall"), ratio(c("kept"), c("total")).alias("coverage"), ratio(c("missed"), c("kept")).alias("unsafe_rate"), ratio(c("missed"), c("cases")).alias("missed_rate"),
    )


def majority(labels: DataFrame, label: str) -> DataFrame:
    """The most frequent label, the smallest among ties."""
    return labels.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)


def logistic(features: DataFrame, label: str = "label", vector: str = "features", c: float = 1.0):  # noqa: ANN201
    """A multinomial logistic regression with an L2 penalty of strength 1 / c on the sum of losses; an error if fewer than two classes."""
    from pyspark.ml.classification import LogisticRegression

    n, classes = features.agg(F.count("*"), F.count_distinct(label)).first()
    if classes < 2:
        raise ValueError(f"logistic regression needs at least two classes; found {classes}")
    return LogisticRegression(featuresCol=vector, labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, family="multinomial", maxIter=200).fit(features)
