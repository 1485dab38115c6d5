"""Checks over tables: each is rows of ``check, violations``, all zero passes; :func:`require` ends a job on the first table that does not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions.text import normalized
from threadloom.operators.graph import hierarchy

# Flags that leave a relationship unresolved.
CONFLICTS = ("parent_response_disagrees", "response_child_disagrees", "conflicting_parent_claim", "conflicting_duplicate_tweet_id", "cyclic_relationships")
CROSSED = "cross_brand_ambiguous"


class ChecksFailed(ValueError):
    """Some check found violations; the message lists all of them."""


def require(checks: DataFrame) -> None:
    """An error that names every check with violations."""
    # One row per check.
    bad = [f"{r['check']}: {r['violations']}" for r in checks.where("violations > 0").orderBy("check").collect()]
    if bad:
        raise ChecksFailed("; ".join(bad))


def eligibility(examples: DataFrame, messages: DataFrame, threads: DataFrame, support_author: str) -> DataFrame:
    """``example_id, reasons``: why an example may not be used, sorted; empty if it may.

    ``examples``: ``example_id, thread_id, customer, text, replies, context, flags`` (ids as in ``messages``: ``id, author, inbound, parent``);
    ``threads``: ``thread_id, flags``, one row per thread. Repeated examples are judged row by row. Null arrays read as empty; an unknown customer
    or reply is invalid. Replies meet their messages by an equality join on exploded ids, never in a lookup held by one task.
    """
    none = F.array().cast("array<string>")
    rows = examples.withColumn("_row", F.monotonically_increasing_id())
    who = messages.select(F.col("id").alias("customer"), F.col("inbound").alias("_inbound"), F.lit(True).alias("_known"))
    reply = messages.select(F.col("id").alias("_reply"), F.col("author").alias("_by"), F.col("inbound").alias("_side"), F.col("parent").alias("_to"), F.lit(True).alias("_there"))
    said = rows.select("example_id", "customer", F.explode(F.array_distinct("replies")).alias("_reply")).distinct().join(reply, "_reply", "left")
    fine = F.col("_there") & (F.col("_by") == support_author) & ~F.col("_side") & (F.col("_to") == F.col("customer"))
    wrong = said.where(~F.coalesce(fine, F.lit(False))).select("example_id", "customer").distinct().withColumn("_wrong", F.lit(True))
    of_thread = threads.select("thread_id", F.array_contains(F.coalesce("flags", none), CROSSED).alias("_crossed"))
    rows = rows.join(who, "customer", "left").join(wrong, ["example_id", "customer"], "left").join(of_thread, "thread_id", "left")
    flags, replies = F.coalesce("flags", none), F.coalesce(F.col("replies").cast("array<string>"), none)
    inputs = F.concat(F.array(F.col("customer").cast("string")), F.coalesce(F.col("context").cast("array<string>"), none))
    reasons = F.array(
        F.when(F.col("_known").isNull() | ~F.coalesce("_inbound", F.lit(False)), "invalid_customer_record"),
        F.when(normalized(F.col("text")) == "", "missing_customer_text"),
        F.when(F.size(replies) == 0, "missing_reference_reply"),
        F.when(F.col("_wrong"), "invalid_customer_brand_pairing"),
        F.when(F.array_contains(flags, CROSSED) | F.coalesce("_crossed", F.lit(False)), CROSSED),
        F.when(F.arrays_overlap(flags, F.array(*[F.lit(c) for c in CONFLICTS])), "unresolved_relationship_conflict"),
        F.when(F.coalesce(F.arrays_overlap(replies, inputs), F.lit(False)), "future_reply_in_input"),
    )
    return rows.select("example_id", F.array_sort(F.array_compact(reasons)).alias("reasons"))


def _one(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def union(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def disjoint(pools: DataFrame, split: str, splits: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """For every pair of splits and every kind of value, how many values stand in both. Array columns count by element; nulls never.

    One aggregate per kind over (value, the splits that hold it): a value shared by a third of all rows is one row after the map side.
    """
    out = []
    for name, value in values.items():
        rows = pools.select(F.col(split).alias("_s"), value.alias("_v"))
        if dict(rows.dtypes)["_v"].startswith("array"):
            rows = rows.select("_s", F.explode("_v").alias("_v"))
        has = [F.coalesce(F.bool_or(F.col("_s") == s), F.lit(False)).alias(f"_h{i}") for i, s in enumerate(splits)]
        per = rows.where("_v is not null").groupBy("_v").agg(*has)
        both = [F.struct(F.lit(f"{name}: {a}, {b}").alias("check"), F.count_if(F.col(f"_h{i}") & F.col(f"_h{j}")).alias("violations")) for (i, a), (j, b) in combinations(enumerate(splits), 2)]
        out.append(per.agg(F.array(*both).alias("_c")).select(F.inline("_c")))
    return union(*out)


def subset(name: str, part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of ``part`` the whole does not hold."""
    return _one(name, part.select(key).distinct().join(whole.select(key), key, "left_anti"))


def apart(name: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys stand in both."""
    return _one(name, a.select(key).distinct().join(b.select(key), key, "left_semi"))


def future_replies(pool: DataFrame) -> DataFrame:
    """Examples ``customer, context, replies`` of which a reply stands in the input."""
    inputs = F.concat(F.array("customer"), F.coalesce("context", F.array().cast(dict(pool.dtypes)["context"])))
    return _one("no_future_reply_in_input", pool.where(F.arrays_overlap(F.col("replies"), inputs)))


def contexts_not_ancestors(pool: DataFrame, messages: DataFrame) -> DataFrame:
    """The rows of ``pool`` (``example_id, customer, context``) whose context is not the set of the ancestors of the customer message.

    Ancestors are worked out anew from ``messages`` (``id, parent``): up to a missing message or a repeat. Compared as sets, by counts: stored
    ids that are ancestors, ancestors in all. Unknown customers have no ancestors.
    """
    tree = hierarchy(messages, F.col("id"), F.col("parent"), with_path=True).select(F.col("node").alias("customer"), "path", "parent")
    rows = pool.select("example_id", "customer", F.array_distinct(F.coalesce("context", F.array().cast(dict(pool.dtypes)["context"]))).alias("context"))
    rows = rows.join(tree, "customer", "left")
    # On a cycle the way up meets the whole cycle, the message itself included.
    up = F.coalesce(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.array().cast(dict(pool.dtypes)["context"]))
    same = (F.size(F.array_except("context", up)) == 0) & (F.size(F.array_except(up, F.col("context"))) == 0)
    return rows.where(~same).select("example_id")


def one_to_one(left: DataFrame, right: DataFrame, key: str, *equal: str) -> DataFrame:
    """Checks of a join that must find exactly one partner with equal attributes: repeated keys of either side, keys without partner, attributes that differ."""
    twice = lambda name, df: _one(name, df.groupBy(key).count().where("count > 1"))
    other = right.select(key, *[F.col(c).alias(f"_{c}") for c in equal], F.lit(True).alias("_there"))
    both = left.select(key, *equal).join(other, key, "left")
    differ = F.lit(False)
    for c in equal:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return union(twice("left_keys_unique", left), twice("right_keys_unique", right), _one("every_key_has_a_partner", both.where("_there is null")), _one("attributes_agree", both.where(F.col("_there") & differ)))


def queues(queue: DataFrame, pool: DataFrame, *equal: str) -> DataFrame:
    """``queue_name, check, violations`` of annotation queues against their pool: repeated examples, positions that do not run from 1, several
    pool digests or seeds, examples that the pool lacks, and attributes that differ from the pool's (``equal``, present in both)."""
    other = pool.groupBy("example_id").agg(*[F.collect_set(c).alias(f"_{c}") for c in equal]).withColumn("_there", F.lit(True))
    rows = queue.join(other, "example_id", "left")
    per = rows.groupBy("queue_name").agg(
        (F.count("*") - F.count_distinct("example_id")).alias("examples_unique"),
        F.when((F.min("queue_position") == 1) & (F.max("queue_position") == F.count("*")) & (F.count_distinct("queue_position") == F.count("*")), 0).otherwise(1).alias("positions_contiguous"),
        (F.count_distinct("candidate_pool_sha256") - 1).alias("one_pool"),
        (F.count_distinct("seed") - 1).alias("one_seed"),
        F.count_if(F.col("_there").isNull()).alias("examples_known"),
        *[F.count_if(F.col("_there") & (F.size(f"_{c}") > 0) & ~F.coalesce(F.array_contains(f"_{c}", F.col(c)), F.lit(False))).alias(f"{c}_agrees") for c in equal],
    )
    names = ["examples_unique", "positions_contiguous", "one_pool", "one_seed", "examples_known", *[f"{c}_agrees" for c in equal]]
    return per.select("queue_name", F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("violations")) for n in names])))


def stale(records: DataFrame, contract: Mapping[str, str]) -> Column:
    """Whether a record was made under another contract: any of its fields differs, nulls too."""
    out = F.lit(False)
    for name, value in contract.items():
        out = out | ~F.col(name).eqNullSafe(F.lit(value))
    return out


def frozen(state: Mapping[str, object], contract: Mapping[str, str]) -> list[str]:
    """Why a queue that needs a frozen contract is locked; empty if it is open."""
    out = [] if state.get("status") == "frozen" else ["not frozen"]
    return out + [f"{k} changed since it was frozen" for k, v in sorted(contract.items()) if state.get(k) != v]


def protected(labels: DataFrame, machines: Sequence[str], expected: int) -> DataFrame:
    """Checks of a human reference set ``example_id, annotator``: its size, repeated ids, labels made by machines."""
    size = labels.agg(F.abs(F.count("*") - expected).alias("violations")).select(F.lit("expected_size").alias("check"), "violations")
    return union(size, _one("ids_unique", labels.groupBy("example_id").count().where("count > 1")), _one("no_machine_labels", labels.where(F.lower("annotator").isin([m.lower() for m in machines]))))


def plain(c: Column) -> Column:
    """Ids as the checks compare them."""
    return ids.name_id(c)
