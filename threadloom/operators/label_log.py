"""Logs of machine labels: their rules, what counts of them, what is still to do, and reports.

A log has one row per try: ``run, example_id, attempt, status (success or failure), input, line`` and what else the caller keeps; ``line``
orders the tries of one example. Keys may be hot: everything is aggregates with a map-side combine, no window over one example's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.validators import _one, union
from threadloom.sources.files import digest


def run_identity(**provenance: object) -> str:
    """The id of a run: a digest of all that its labels depend on (model, prompt, schema, queue, pool); another value is another run."""
    return digest(provenance)


def fingerprint(names: Sequence[str], texts: Mapping[str, str]) -> dict[str, str]:
    """The contract that labels are made under: a digest per named document."""
    return {f"{n}_sha256": digest(texts[n]) for n in names}


def latest(log: DataFrame) -> DataFrame:
    """The last try of each example; later lines win."""
    names = [c for c in log.columns if c != "example_id"]
    return log.groupBy("example_id").agg(F.max_by(F.struct(*names), "line").alias("_l")).select("example_id", *[F.col("_l").getField(c).alias(c) for c in names])


def log_checks(log: DataFrame, members: DataFrame, run: str | None = None) -> DataFrame:
    """``check, violations``: tries of another run, examples that the queue lacks, attempts that do not count 1, 2, 3 in order of lines, tries after a success.

    Attempts count up exactly if they are distinct, run from 1 to their number, and rise with the lines; the last is told by the first and
    last line of each attempt and of the one before, joined by number.
    """
    per = log.groupBy("example_id").agg(F.count("*").alias("n"), F.count_distinct("attempt").alias("d"), F.min("attempt").alias("lo"), F.max("attempt").alias("hi"), F.min(F.when(F.col("status") == "success", F.col("line"))).alias("won"), F.max("line").alias("last"))
    gaps = per.where((F.col("n") != F.col("d")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")))
    at = log.groupBy("example_id", "attempt").agg(F.min("line").alias("first"), F.max("line").alias("end"))
    before = at.select("example_id", (F.col("attempt") + 1).alias("attempt"), F.col("end").alias("_end"))
    turned = at.join(before, ["example_id", "attempt"]).where("first < _end").select("example_id").distinct()
    other = log.where(F.col("run") != run) if run is not None else log.limit(0)
    return union(
        _one("one_run", other),
        _one("examples_of_the_queue", log.join(members.select("example_id"), "example_id", "left_anti")),
        _one("attempts_contiguous", gaps.select("example_id").union(turned).distinct()),
        _one("nothing_after_success", per.where("last > won")),
    )


def successes(log: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of successful tries that no hold (``run, example_id``) takes out."""
    return log.where("status = 'success'").join(held.select("run", "example_id").distinct(), ["run", "example_id"], "left_anti")


def selected(queue: DataFrame, human: DataFrame, log: DataFrame, runs: Sequence[str], held: DataFrame) -> DataFrame:
    """``position, example_id, run, attempt``: one machine label per example of the queue, in its order.

    Human labels win: their examples are left out. Then the first of ``runs`` with a success that is not held, retained runs before the
    active one; runs that are not named do not count, and a run named twice is an error.
    """
    if len(set(runs)) != len(runs):
        raise ValueError("a run is named twice")
    rank = F.array_position(F.array(*[F.lit(r) for r in runs]), F.col("run"))
    best = successes(log.where(F.col("run").isin(list(runs))), held).groupBy("example_id").agg(F.min_by(F.struct("run", "attempt"), F.struct(rank, -F.col("line"))).alias("_b"))
    rows = queue.select("position", "example_id").join(human.select("example_id"), "example_id", "left_anti").join(best, "example_id")
    return rows.select("position", "example_id", "_b.run", "_b.attempt").orderBy("position", "example_id")


def pending(queue: DataFrame, human: DataFrame, chosen: DataFrame, log: DataFrame, only: DataFrame | None = None, one_attempt: bool = False) -> DataFrame:
    """``position, example_id`` of what is still to label: neither human nor chosen; within ``only`` if given, and never tried if ``one_attempt``."""
    rows = queue.select("position", "example_id").join(human.select("example_id"), "example_id", "left_anti").join(chosen.select("example_id"), "example_id", "left_anti")
    if only is not None:
        rows = rows.join(only.select("example_id"), "example_id", "left_semi")
    if one_attempt:
        rows = rows.join(log.select("example_id"), "example_id", "left_anti")
    return rows.orderBy("position", "example_id")


def report(queue: DataFrame, human: DataFrame, log: DataFrame) -> DataFrame:
    """One row: ``expected, successes, failures, not_attempted, superseded, complete`` of a run over the examples without a human label."""
    last = latest(log).select("example_id", "status")
    rows = queue.select("example_id").distinct().join(human.select("example_id").distinct().withColumn("_human", F.lit(True)), "example_id", "left").join(last, "example_id", "left")
    free = F.col("_human").isNull()
    out = rows.agg(
        F.count_if(free).alias("expected"), F.count_if(free & (F.col("status") == "success")).alias("successes"), F.count_if(free & (F.col("status") == "failure")).alias("failures"),
        F.count_if(free & F.col("status").isNull()).alias("not_attempted"), F.count_if(F.col("_human") & F.col("status").isNotNull()).alias("superseded"),
    )
    return out.withColumn("complete", F.col("successes") == F.col("expected"))


def by_provider(chosen: DataFrame, providers: Mapping[str, str]) -> DataFrame:
    """``provider, labels``: how many selected labels come from each provider, by the provider of each run."""
    names = F.create_map(*[F.lit(x) for pair in providers.items() for x in pair])
    return chosen.groupBy(names[F.col("run")].alias("provider")).agg(F.count("*").alias("labels"))


def history(log: DataFrame, excluded_runs: Mapping[str, str], held: DataFrame) -> DataFrame:
    """``example_id, run, attempt, reason, status``: tries that do not count because their run is excluded or they are held, and why. Nothing is erased."""
    whole = log.where(F.col("run").isin(list(excluded_runs)))
    names = F.create_map(*[F.lit(x) for pair in (excluded_runs or {"": ""}).items() for x in pair])
    a = whole.select("example_id", "run", "attempt", names[F.col("run")].alias("reason"), F.lit("run excluded").alias("status"))
    b = log.join(held.select("run", "example_id", "reason"), ["run", "example_id"]).select("example_id", "run", "attempt", "reason", F.lit("record held").alias("status"))
    return a.unionByName(b)


def revised(changes: DataFrame, key: str, order: str, revision: str) -> DataFrame:
    """``changes`` with ``revised``: the larger of the given revision and one more than the one before it in the order.

    ``max(given, before + 1)`` over a sequence is ``place + max over earlier (given - place)``: a running maximum. Order values of a key are distinct.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(order)
    rows = changes.withColumn("_n", F.row_number().over(w))
    return rows.withColumn("revised", F.col("_n") + F.max(F.col(revision) - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def completion(queue: DataFrame, records: DataFrame, is_stale: Column, first: int | None = None) -> DataFrame:
    """Per queue ``expected, complete, judgment_saved, skipped, missing, stale, complete_current, ready`` of human records ``example_id, status``.

    With ``first`` only so many first positions of each queue count, as in a pilot; ``ready``: all of them are complete and current.
    """
    rows = queue if first is None else queue.where(F.col("queue_position") <= first)
    has = records.withColumn("_stale", is_stale).select("queue_name", "example_id", "status", "_stale")
    rows = rows.select("queue_name", "example_id").distinct().join(has, ["queue_name", "example_id"], "left")
    s = F.col("status")
    out = rows.groupBy("queue_name").agg(
        F.count("*").alias("expected"), F.count_if(s == "complete").alias("complete"), F.count_if(s == "judgment_saved").alias("judgment_saved"), F.count_if(s == "skipped").alias("skipped"),
        F.count_if(s.isNull()).alias("missing"), F.count_if(F.col("_stale")).alias("stale"), F.count_if((s == "complete") & ~F.col("_stale")).alias("complete_current"),
    )
    return out.withColumn("ready", F.col("complete_current") == F.col("expected"))


def as_events(tries: DataFrame, run: str) -> DataFrame:
    """The log rows that tries become: ``outcome`` success, or an error code. Bad output and errors of the provider are failures, a pause is no try at all.

    ``tries`` has ``example_id, line, outcome``. Attempts count the rows of an example that are no pauses.
    """
    from pyspark.sql.window import Window

    rows = tries.where("outcome <> 'pause'")
    n = F.row_number().over(Window.partitionBy("example_id").orderBy("line")).cast("int")
    ok = F.col("outcome") == "success"
    return rows.select(F.lit(run).alias("run"), "example_id", n.alias("attempt"), F.when(ok, "success").otherwise("failure").alias("status"), F.when(~ok, F.col("outcome")).alias("error_code"), "line")
