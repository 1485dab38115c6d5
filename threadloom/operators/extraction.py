"""From raw message rows to threads, relationships and support examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import ids
from threadloom.functions.hashing import row_digest, stable_id
from threadloom.operators.graph import connected_components, hierarchy
from threadloom.workspace import Workspace


def parsed(records: DataFrame) -> DataFrame:
    """Typed columns of raw rows: ``source_record, id, author, inbound, moment, text, responses, parent, flags, digest``.

    ``responses`` are the distinct ids of ``response_tweet_id`` in order, split at commas; ``parent`` is the one id of
    ``in_response_to_tweet_id``, null with a flag if it holds several or none that reads as an id.
    """
    tokens = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), ids.message_id), lambda x: x.isNotNull())
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("in_response_to_tweet_id"), F.lit("")), ","), ids.stripped), lambda x: x != "")
    parent = F.when(F.size(parts) == 1, ids.message_id(F.element_at(parts, 1)))
    side, moment, time = ids.flag(F.col("inbound")), ids.moment(F.col("created_at")), ids.cleaned(F.col("created_at"))
    flags = F.array_sort(
        F.array_compact(
            F.array(
                F.when(time.isNull(), "missing_timestamp").when(moment.isNull(), "invalid_timestamp"),
                F.when(ids.cleaned(F.col("text")).isNull(), "missing_text"),
                F.when(side.isNull(), "invalid_inbound"),
                F.when((F.size(parts) > 0) & parent.isNull(), "invalid_parent_format"),
                F.when(ids.message_id(F.col("tweet_id")).isNull(), "missing_id"),
            )
        )
    )
    rows = records.select(
        "source_record",
        ids.message_id(F.col("tweet_id")).alias("id"),
        ids.cleaned(F.col("author_id")).alias("author"),
        side.alias("inbound"),
        moment.alias("moment"),
        F.col("text"),
        F.array_distinct(tokens(F.col("response_tweet_id"))).alias("responses"),
        parent.alias("parent"),
        flags.alias("flags"),
    )
    return rows.withColumn("digest", row_digest(F.col("author"), F.col("inbound"), F.unix_micros("moment"), F.col("text"), F.array_join(F.col("responses").cast("array<string>"), ","), F.col("parent")))


def require_author(rows: DataFrame, author: str) -> None:
    """An error if no row is by this author, naming the spellings that differ only in case."""
    # At most one row per spelling of one name.
    found = [r["author"] for r in rows.where(F.lower("author") == author.lower()).select("author").distinct().collect()]
    if author not in found:
        raise ValueError(f"no rows by {author}" + (f"; other spellings: {', '.join(sorted(found))}" if found else ""))


def audit_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows first by the digest of their key."""
    return rows.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(size)


def flag_union(relations: DataFrame, messages: DataFrame, members: DataFrame) -> DataFrame:
    """``thread_id, flags``: the flags of all messages of a thread and of the links that touch it, at either end, sorted.

    ``relations`` as of :func:`relationships`; statuses other than ``consistent`` and ``parent_response_unspecified`` are flags.
    """
    own = messages.select("id", F.explode("flags").alias("flag"))
    odd = relations.where("status not in ('consistent', 'parent_response_unspecified')")
    ends = odd.select(F.explode(F.array("parent", "child")).alias("id"), F.col("status").alias("flag"))
    both = own.unionByName(ends).join(members.select("id", "thread_id"), "id")
    return both.groupBy("thread_id").agg(F.array_sort(F.collect_set("flag")).alias("flags"))


def canonical(rows: DataFrame) -> DataFrame:
    """The first row of each id of :func:`parsed`, with ``copies`` and ``variants``; rows without id are left out.

    Copies and variants come from a narrow aggregate; whole rows are picked by their unique record number.
    """
    stats = rows.where("id is not null").groupBy("id").agg(F.min("source_record").alias("source_record"), F.count("*").alias("copies"), F.count_distinct("digest").alias("variants"))
    return rows.drop("id").join(stats, "source_record")


def duplicates(rows: DataFrame) -> DataFrame:
    """Every row of an id that came more than once, with the counts of its id."""
    stats = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("copies"), F.count_distinct("digest").alias("variants")).where("copies > 1")
    return rows.join(stats, "id").select("source_record", "id", "author", "copies", "variants")


def claims(messages: DataFrame) -> DataFrame:
    """``parent, child, ordinal``: the answers every canonical message claims, in their order."""
    return messages.select(F.col("id").alias("parent"), F.posexplode("responses").alias("ordinal", "child")).select("parent", "child", "ordinal")


def threads(messages: DataFrame, support_author: str | None = None) -> DataFrame:
    """``id, root_label, thread_id`` by direct-parent links between present messages.

    With a support author only threads in which that author wrote are kept. ``thread_id`` is the stable id of the sorted members;
    it comes from a digest of per-member digests that adds up on the map side, so no thread is gathered in one task.
    """
    present = messages.select(F.col("id").alias("parent"))
    links = messages.where("parent is not null").select("id", "parent").join(present, "parent", "left_semi")
    labels = connected_components(links, "id", "parent").select(F.col("node").alias("id"), F.col("label").alias("root_label"))
    out = messages.select("id", "author").join(labels, "id", "left").select("id", "author", F.coalesce("root_label", "id").alias("root_label"))
    if support_author is not None:
        ours = out.where(F.col("author") == support_author).select("root_label").distinct()
        out = out.join(ours, "root_label", "left_semi")
    named = out.groupBy("root_label").agg(F.sum(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n"))
    named = named.select("root_label", stable_id("thread", F.array(F.col("root_label").cast("string"), F.col("_n").cast("string"), F.col("_sum").cast("string"))).alias("thread_id"))
    return out.join(named, "root_label").select("id", "root_label", "thread_id")


def relationships(messages: DataFrame, members: DataFrame) -> DataFrame:
    """``parent, child, direct, claimed, status`` of every direct link and every claim that no direct link confirms, in the given threads.

    Direct: ``missing_parent_target``, ``consistent``, ``parent_response_disagrees`` (the parent claims other answers) or
    ``parent_response_unspecified`` (it claims none). Claims only: ``response_target_missing``, ``response_only_unconfirmed``
    (the target names no parent) or ``conflicting_parent_claim`` (it names another).
    """
    inside = messages.join(members.select("id"), "id", "left_semi")
    said = claims(inside).select("parent", "child").withColumn("claimed", F.lit(True))
    upper = messages.select(F.col("id").alias("parent"), (F.size("responses") > 0).alias("_says"), F.lit(True).alias("_there"))
    direct = inside.where("parent is not null").select("parent", F.col("id").alias("child")).join(upper, "parent", "left").join(said, ["parent", "child"], "left")
    direct = direct.select(
        "parent",
        "child",
        F.lit(True).alias("direct"),
        F.coalesce("claimed", F.lit(False)).alias("claimed"),
        F.when(F.col("_there").isNull(), "missing_parent_target").when(F.col("claimed"), "consistent").when(F.col("_says"), "parent_response_disagrees").otherwise("parent_response_unspecified").alias("status"),
    )
    lower = messages.select(F.col("id").alias("child"), F.col("parent").alias("_named"), F.lit(True).alias("_there"))
    only = said.join(lower, "child", "left").where("_there is null or _named is null or _named <> parent")
    only = only.select(
        "parent",
        "child",
        F.lit(False).alias("direct"),
        F.lit(True).alias("claimed"),
        F.when(F.col("_there").isNull(), "response_target_missing").when(F.col("_named").isNull(), "response_only_unconfirmed").otherwise("conflicting_parent_claim").alias("status"),
    )
    return direct.unionByName(only)


def rollup(messages: DataFrame, members: DataFrame, support_author: str) -> DataFrame:
    """One row per thread: counts by side and author, other outbound authors, first and last valid moment, duplicate conflicts."""
    rows = messages.join(members, "id")
    return rows.groupBy("thread_id").agg(
        F.count("*").alias("messages"),
        F.count_if("inbound").alias("inbound_messages"),
        F.count_if(~F.col("inbound")).alias("outbound_messages"),
        F.count_if(F.col("author") == support_author).alias("support_messages"),
        F.array_sort(F.collect_set(F.when(~F.col("inbound") & (F.col("author") != support_author), F.col("author")))).alias("other_outbound_authors"),
        F.min("moment").alias("started_at"),
        F.max("moment").alias("ended_at"),
        F.coalesce(F.bool_or(F.col("variants") > 1), F.lit(False)).alias("conflicting_duplicates"),
    )


def examples(messages: DataFrame, members: DataFrame, support_author: str) -> DataFrame:
    """``customer, thread_id, context, replies, reasons`` of every inbound message that the support author answers directly or is said to answer.

    ``replies`` are the direct outbound answers of the support author by time; ``context`` the ancestors up to a missing message or
    a repeat, by time, unreadable times last, then by record number; ``turned`` tells that this is not the order of the answers.
    ``reasons`` tells why a message makes no example; empty for examples.
    """
    work = Workspace(messages.sparkSession, "examples")
    inside = work.save(messages.join(members, "id").drop("flags"))
    key = lambda *extra: F.struct(F.col("moment").isNull().alias("a"), F.col("moment").alias("b"), F.col("source_record").alias("c"), F.col("id").alias("id"), *extra)
    replies = inside.where((F.col("author") == support_author) & ~F.col("inbound") & F.col("parent").isNotNull())
    replies = replies.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(key())).alias("_r"), F.bool_or(ids.cleaned(F.col("text")).isNull()).alias("_mute"))
    author_of = messages.select(F.col("id").alias("child"), F.col("author").alias("_by"))
    claimed = claims(inside).join(author_of, "child").where(F.col("_by") == support_author).select(F.col("parent").alias("id")).distinct().withColumn("_claimed", F.lit(True))
    tree = work.save(hierarchy(inside, F.col("id"), F.col("parent"), with_path=True).select("node", "in_cycle", "path"))
    cyclic = tree.where("in_cycle = 1").select(F.col("node").alias("id")).join(members, "id").select("thread_id").distinct().withColumn("_cyclic", F.lit(True))
    cross = relationships(messages, members).where("not direct and status <> 'response_target_missing'").join(messages.select(F.col("id").alias("child"), "author", "inbound"), "child")
    cross = cross.where(~F.col("inbound") & (F.coalesce(F.col("author"), F.lit("")) != support_author)).select(F.col("parent").alias("id")).join(members, "id").select("thread_id")
    per = rollup(messages, members, support_author).select("thread_id", (F.size("other_outbound_authors") > 0).alias("_others"), F.col("conflicting_duplicates").alias("_conflict"))
    per = per.join(cyclic, "thread_id", "left").join(cross.distinct().withColumn("_cross", F.lit(True)), "thread_id", "left")
    rows = inside.where("inbound").select("id", "thread_id", "text").join(replies, "id", "left").join(claimed, "id", "left").where("_r is not null or _claimed").join(per, "thread_id")
    above = tree.select(F.col("node").alias("id"), "path").join(rows.select("id"), "id", "left_semi").select("id", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_place", "_up"))
    above = above.join(inside.select(F.col("id").alias("_up"), "moment", "source_record"), "_up")
    above = above.groupBy(F.col("id").alias("_c")).agg(F.array_sort(F.collect_list(F.struct(F.col("moment").isNull().alias("a"), F.col("moment").alias("b"), F.col("source_record").alias("c"), F.col("_up").alias("id"), F.col("_place").alias("place")))).alias("_ctx"))
    out = rows.join(above, F.col("id") == F.col("_c"), "left")
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.col("_r").isNull(), "no_verified_direct_reply"),
                F.when(F.col("_others") | F.col("_cross"), "cross_brand_ambiguous"),
                F.when(F.col("_conflict"), "conflicting_duplicates"),
                F.when(F.col("_cyclic"), "cyclic_relationships"),
                F.when(ids.cleaned(F.col("text")).isNull(), "missing_customer_text"),
                F.when(F.col("_mute"), "missing_reply_text"),
            )
        )
    )
    names = lambda c: F.coalesce(F.transform(F.col(c), lambda x: x["id"]), F.array().cast("array<bigint>"))
    # Every ancestor carries its depth, so the order of answers is at hand without the path.
    causal = F.coalesce(F.transform(F.array_sort(F.transform(F.col("_ctx"), lambda x: F.struct(x["place"].alias("p"), x["id"].alias("id")))), lambda x: x["id"]), F.array().cast("array<bigint>"))
    return out.select(F.col("id").alias("customer"), "thread_id", names("_ctx").alias("context"), names("_r").alias("replies"), reasons.alias("reasons"), (names("_ctx") != causal).alias("turned"))
