"""Deterministic samples by content hash, with at most one record of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.hashing import rank_hash

# Coverage buckets and their patterns over lower-case text, in the order of precedence.
COVERAGE = (
    ("security", r"\b(hack|hijack|compromis|not me|unauthori[sz]|stolen)"),
    ("billing", r"\b(charge|refund|payment|card|bill|price|paid)"),
    ("membership", r"\b(premium|family plan|student|subscription|trial|invite)"),
    ("account", r"\b(log ?in|password|username|account|email address|facebook)"),
    ("catalog", r"\b(album|artist|song|track|catalog|library)\b.*\b(missing|removed|available|add|wrong)"),
    ("library_playlist", r"\b(playlist|download|saved|library|10,?000|queue)"),
    ("playback", r"\b(play|playing|shuffle|skip|audio|sound|pause|autoplay)"),
    ("app_device", r"\b(app|iphone|ios|android|desktop|web player|bluetooth|speaker|crash|bug)"),
    ("feature_market", r"\b(feature|support|available in|country|watch|fitbit|siri|notification)"),
)
# Observable challenge flags and their patterns.
SECURITY_WORDING = r"\b(hack(?:ed|er)?|hijack(?:ed)?|compromis(?:e|ed)|unauthori[sz]ed|not me|someone (?:has|got|changed|signed)|stolen account)\b"
DISPUTE_WORDING = r"\b(refund|charged? (?:me )?(?:twice|double|extra|more)|unknown charge|fraudulent charge|never signed up|account i don.t have|money back)\b"
FLAGS = ("very_short_message", "missing_preceding_context", "multiple_question_clauses", "security_related_wording", "account_specific_payment_dispute_wording")
SHORT = 40


def bucket(text: Column, context: Column) -> Column:
    """The first bucket whose pattern the text has; short texts and texts without context apart, the rest ``general``."""
    low = F.lower(text)
    out = None
    for name, pattern in COVERAGE:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    bare = (F.length(F.trim(low)) <= SHORT) | (F.coalesce(F.size(context), F.lit(0)) < 1)
    return out.when(bare, "short_or_context_limited").otherwise("general")


def challenge_flags(text: Column, context: Column) -> Column:
    low = F.lower(F.trim(text))
    tests = (F.length(low) <= SHORT, F.coalesce(F.size(context), F.lit(0)) < 1, F.regexp_count(low, F.lit(r"\?")) >= 2, low.rlike(SECURITY_WORDING), low.rlike(DISPUTE_WORDING))
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in zip(FLAGS, tests, strict=True)]))


def ranked(pool: DataFrame, seed: int, namespace: str) -> DataFrame:
    """The record of smallest hash of each group, with ``rank_key``; groups must hold whole threads."""
    keyed = pool.withColumn("rank_key", rank_hash(seed, namespace, F.col("example_id")))
    best = F.row_number().over(Window.partitionBy("group_id").orderBy("rank_key", "example_id"))
    return keyed.withColumn("_best", best).where("_best = 1").drop("_best")


class Shortfall(ValueError):
    """A pool holds fewer groups than a sample asks for."""


def _enough(found: int, wanted: int, name: str, strict: bool) -> None:
    if strict and found < wanted:
        raise Shortfall(f"{name}: {found} of {wanted}")


def uniform(pool: DataFrame, size: int, seed: int, namespace: str, strict: bool = False) -> DataFrame:
    """``position, example_id, group_id`` of the ``size`` first groups by hash; with ``strict`` fewer groups are an error."""
    if strict:
        _enough(pool.select("group_id").distinct().limit(size).count(), size, namespace, strict)
    top = ranked(pool, seed, namespace).orderBy("rank_key", "example_id").limit(size)
    return top.select(F.row_number().over(Window.orderBy("rank_key", "example_id")).alias("position"), "example_id", "group_id")


def stratified(pool: DataFrame, size: int, seed: int, strict: bool = False) -> DataFrame:
    """``position, example_id, group_id, stratum``: an equal number from every coverage bucket in order, then the remainder by hash.

    Groups taken by an earlier bucket are left out of later ones. Per bucket at most ``size`` rows come to the driver: the result's own
    bound. With ``strict`` a sample that falls short is an error.
    """
    names = [n for n, _ in COVERAGE] + ["short_or_context_limited", "general"]
    per = max(1, size // len(names))
    rows = pool.withColumn("bucket", bucket(F.col("text"), F.col("context")))
    taken: list[tuple[int, str, str, str]] = []
    used: list[str] = []
    for name, source, take in [(n, rows.where(F.col("bucket") == n), per) for n in names] + [("remainder", rows, size)]:
        free = source.where(~F.col("group_id").isin(used)) if used else source
        want = take if name != "remainder" else size - len(taken)
        if want <= 0:
            break
        for r in ranked(free, seed, f"training:{name}").orderBy("rank_key", "example_id").limit(want).collect():
            taken.append((len(taken) + 1, r["example_id"], r["group_id"], f"coverage:{name}"))
            used.append(r["group_id"])
    _enough(len(taken), size, "stratified", strict)
    return pool.sparkSession.createDataFrame(taken[:size], "position int, example_id string, group_id string, stratum string")


def challenge(pool: DataFrame, random_size: int, challenge_size: int, seed: int, strict: bool = False) -> DataFrame:
    """``position, example_id, group_id, stratum``: a random stratum, then turns over the challenge flags that skip groups already taken.

    A flag can give at most ``random_size + challenge_size`` candidates to skip or take, so only so many per flag leave Spark. With ``strict`` a
    stratum that falls short is an error.
    """
    first = ranked(pool, seed, "golden:random").orderBy("rank_key", "example_id").limit(random_size).collect()
    out = [(i + 1, r["example_id"], r["group_id"], "random") for i, r in enumerate(first)]
    used = {r["group_id"] for r in first}
    flagged = pool.withColumn("flags", challenge_flags(F.col("text"), F.col("context")))
    lists = {f: iter(ranked(flagged.where(F.array_contains("flags", f)), seed, f"golden:challenge:{f}").orderBy("rank_key", "example_id").limit(random_size + challenge_size).collect()) for f in FLAGS}
    left, live = challenge_size, True
    while left and live:
        live = False
        for f in FLAGS:
            r = next((x for x in lists[f] if x["group_id"] not in used), None)
            if r is None or not left:
                continue
            out.append((len(out) + 1, r["example_id"], r["group_id"], f"challenge:{f}"))
            used.add(r["group_id"])
            left, live = left - 1, True
    _enough(len(first), random_size, "random", strict)
    _enough(challenge_size - left, challenge_size, "challenge", strict)
    return pool.sparkSession.createDataFrame(out, "position int, example_id string, group_id string, stratum string")


def extend(queue: DataFrame, pool: DataFrame, size: int, seed: int, namespace: str, buckets: Sequence[str] | None = None, strict: bool = False) -> DataFrame:
    """The queue with ``size`` more records of groups it does not hold, at the positions that follow; of the named coverage buckets only, if any are named."""
    fresh = pool.join(queue.select("group_id"), "group_id", "left_anti")
    if buckets is not None:
        fresh = fresh.where(bucket(F.col("text"), F.col("context")).isin(list(buckets)))
    more = uniform(fresh, size, seed, namespace, strict)
    last = queue.agg(F.coalesce(F.max("position"), F.lit(0)).alias("_last"))
    more = more.crossJoin(F.broadcast(last)).select((F.col("position") + F.col("_last")).alias("position"), "example_id", "group_id")
    return queue.select("position", "example_id", "group_id").unionByName(more)


def pinned(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """``position, example_id, moved``: pinned records in queue order; ``moved`` where the queue no longer holds them at their place."""
    now = queue.select("example_id", F.col("position").alias("_now"))
    return wanted.join(now, "example_id", "left").select("position", "example_id", (~F.col("position").eqNullSafe(F.col("_now"))).alias("moved"))
