"""How long a request has to wait for its budget: rolling minutes and days over a ledger of reservations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.ranking import running_totals
from threadloom.workspace import Workspace, scope

#: Reservations leave the rolling minute this many seconds after they were made.
RELEASE = 60.1
DAY = 86400


@dataclass(frozen=True)
class Budget:
    """Ceilings of one model; None sets none. ``interval`` is the least time between two requests."""

    requests_per_minute: int
    tokens_per_minute: int
    input_tokens_per_minute: int | None = None
    output_tokens_per_minute: int | None = None
    requests_per_day: int | None = None
    tokens_per_day: int | None = None
    interval: float = 0.0


def _within(asked: DataFrame, made: DataFrame, length: int) -> DataFrame:
    """Every request with the reservations of the ``length`` seconds before it, the far end open: an equality join on two slots of time."""
    slot = lambda c: F.floor(c / length)
    left = asked.withColumn("_slot", F.explode(F.array(slot(F.col("now")), slot(F.col("now")) - 1)))
    right = made.withColumn("_slot", slot(F.col("time")))
    return left.join(right, ["model", "_slot"]).where((F.col("time") > F.col("now") - length) & (F.col("time") <= F.col("now")))


def waits(asked: DataFrame, ledger: DataFrame, budget: Budget) -> DataFrame:
    """``request, wait, pause``: seconds that each request has to wait, or why it must not be sent at all (then ``wait`` is null).

    ``asked`` has ``request, model, now, input_tokens, output_tokens``; ``ledger`` has ``model, kind (reservation or response), time,
    input_tokens, output_tokens, limit_category, headers (as of :func:`threadloom.functions.transport.quota_headers`)``.

    The oldest reservations of the minute are dropped until the request fits, and the last one dropped leaves after 60.1 seconds: a
    reservation must leave exactly if it and all later ones of the minute leave no room, that is, if what was reserved before it is less than all
    so far plus the request less the ceiling. Requests are placed among the reservations twice, by time and by what was reserved before, and
    running totals and maxima over range slices tell the rest, so no request is joined with the reservations of its minute or day. Only models
    with negative tokens, whose totals do not rise, are joined by the minute. A server limit lowers a ceiling and never raises one; failed
    requests keep their reservation. Nulls: tokens read as 0; without a model or a time nothing is before a request.
    """
    work = Workspace(asked.sparkSession, "ledger")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rows = work.save(asked.select("request", "model", F.col("now").cast("double").alias("now"), zero("input_tokens").alias("_in"), zero("output_tokens").alias("_out"), F.monotonically_increasing_id().alias("_q")))
    book = ledger.withColumn("time", F.col("time").cast("double")).where("model is not null and time is not null")
    made = book.where("kind = 'reservation'").select("model", "time", F.lit(0).alias("_kind"), zero("input_tokens").alias("r_in"), zero("output_tokens").alias("r_out"))
    said = book.where("kind = 'response'").select("model", "time", F.lit(0).alias("_kind"), F.struct("time", "limit_category").alias("_s"), F.when(F.col("headers").isNotNull(), F.struct("time", "headers")).alias("_h"))
    # A day back is looked up only if something limits the day.
    daily = budget.requests_per_day is not None or budget.tokens_per_day is not None or not said.where("_h.headers.limit_requests is not null").isEmpty()
    moments = [F.struct(F.col("now").alias("time"), F.lit(1).alias("_kind"))] + [F.struct((F.col("now") - DAY).alias("time"), F.lit(2).alias("_kind"))] * daily
    probes = rows.where("model is not null and now is not null").select("model", "_q", F.inline(F.array(*moments)))
    placed = made.unionByName(said, allowMissingColumns=True).unionByName(probes, allowMissingColumns=True)
    sums = {"_c_n": F.col("r_in").isNotNull().cast("bigint"), "_c_in": F.col("r_in"), "_c_out": F.col("r_out")}
    with scope():  # the slices go as soon as their totals are written
        held = running_totals(placed, "model", [F.col("time"), F.col("_kind")], sums, largest={"_latest": F.when(F.col("r_in").isNotNull(), F.col("time")), "_said": F.col("_s"), "_last": F.col("_h")})
        placed, seen = work.save_and_count(held.drop("_s", "_h"), negative=(F.col("r_in") < 0) | (F.col("r_out") < 0))
    at = lambda kind, c, name: F.max(F.when(F.col("_kind") == kind, F.col(c))).alias(name)
    known = placed.where("_kind > 0").groupBy("_q").agg(*[at(1, c, c) for c in [*sums, "_latest", "_said", "_last"]], *[at(2, c, f"_ago{c}") for c in sums])
    rows = rows.join(known.withColumn("_category", F.col("_said.limit_category")).drop("_said"), "_q", "left")
    head = lambda f: F.col(f"_last.headers.{f}")
    rows = rows.withColumn("_tpm", F.least(F.lit(budget.tokens_per_minute), head("limit_tokens")))
    rows = rows.withColumn("_rpd", F.least(F.lit(budget.requests_per_day).cast("bigint"), head("limit_requests")))
    day = F.col("_c_n") - F.col("_ago_c_n")
    rows = rows.withColumn("_n", F.when(day > 0, day)).withColumn("_t", F.when(day > 0, F.col("_c_in") + F.col("_c_out") - F.col("_ago_c_in") - F.col("_ago_c_out")))
    rows = work.save(rows.withColumn("_latest", F.when(F.col("_latest") > F.col("now") - DAY, F.col("_latest"))))
    dimensions: dict[str, tuple[Column, Column, Column, Column]] = {
        "requests": (F.col("_c_n"), F.lit(1), F.lit(1), F.lit(budget.requests_per_minute)),
        "tokens": (F.col("_c_in") + F.col("_c_out"), F.col("r_in") + F.col("r_out"), F.col("_in") + F.col("_out"), F.col("_tpm")),
        "input_tokens": (F.col("_c_in"), F.col("r_in"), F.col("_in"), F.lit(budget.input_tokens_per_minute).cast("bigint")),
        "output_tokens": (F.col("_c_out"), F.col("r_out"), F.col("_out"), F.lit(budget.output_tokens_per_minute).cast("bigint")),
    }
    unset = {"input_tokens": budget.input_tokens_per_minute is None, "output_tokens": budget.output_tokens_per_minute is None}
    # Per ceiling: what was reserved before a reservation, and what a reservation must have before it to be allowed to stay.
    bound = [(n, total - amount, total + cost - cap) for n, (total, amount, cost, cap) in dimensions.items() if not unset.get(n)]
    spots = placed.where("r_in is not null").select("model", "time", F.lit(1).alias("_kind"), F.inline(F.array(*[F.struct(F.lit(n).alias("_d"), before.alias("_v")) for n, before, _ in bound])))
    limits = rows.where("_latest > now - 60").select("model", "_q", "now", F.lit(0).alias("_kind"), F.inline(F.array(*[F.struct(F.lit(n).alias("_d"), limit.alias("_v")) for n, _, limit in bound]))).where("_v is not null")
    leaves = None
    if seen["negative"]:
        odd = work.save(placed.where("r_in < 0 or r_out < 0").select("model").distinct())
        pairs = _within(limits.join(odd, "model", "left_semi").withColumnRenamed("_v", "_limit").drop("_kind"), spots.join(odd, "model", "left_semi").withColumnRenamed("_d", "_of"), 60)
        leaves = pairs.where("_of = _d and _v < _limit").select("_q", "time")
        spots, limits = spots.join(odd, "model", "left_anti"), limits.join(odd, "model", "left_anti")
    both = spots.unionByName(limits, allowMissingColumns=True).withColumn("_of", F.concat("_d", F.lit(":"), "model")).drop("model", "_d")
    with scope():
        found = running_totals(both, "_of", [F.col("_v"), F.col("_kind")], {}, largest={"_at": F.col("time")}).where("_kind = 0 and _at > now - 60").select("_q", F.col("_at").alias("time"))
        free = work.save((found if leaves is None else found.unionByName(leaves)).groupBy("_q").agg((F.max("time") + RELEASE).alias("_free")))
    work.drop(placed)
    rows = rows.join(free, "_q", "left")
    cost = F.col("_in") + F.col("_out")
    too_big = F.lit(False)
    for _, _, c, cap in dimensions.values():
        too_big = too_big | F.coalesce(c > cap, F.lit(False))
    pause = F.when(F.col("_category").isin("daily", "billing", "quota_unavailable"), F.concat(F.lit("saved limit: "), F.col("_category")))
    pause = pause.when(F.coalesce(F.col("_n") >= F.col("_rpd"), F.lit(False)), "daily requests used up")
    if budget.tokens_per_day is not None:
        pause = pause.when(F.coalesce("_t", F.lit(0)) + cost > budget.tokens_per_day, "daily tokens used up")
    pause = pause.when(too_big, "single request above a ceiling")
    spacing = max(budget.interval, 60 / budget.requests_per_minute + 0.1)
    wait = F.greatest(F.lit(0.0), F.col("_free") - F.col("now"), F.col("_latest") + spacing - F.col("now"))
    for name, c in (("requests", F.lit(1)), ("tokens", cost)):
        short = F.coalesce(head(f"remaining_{name}") < c, F.lit(False))
        pause = pause.when(short & head(f"reset_{name}_seconds").isNull(), F.lit(f"remaining {name} do not suffice and no reset is known"))
        wait = F.greatest(wait, F.when(short, F.col("_last.time") + head(f"reset_{name}_seconds") + 0.1 - F.col("now")))
    return rows.select("request", pause.alias("pause"), wait.alias("wait")).select("request", F.when(F.col("pause").isNull(), F.round("wait", 6)).alias("wait"), "pause")
