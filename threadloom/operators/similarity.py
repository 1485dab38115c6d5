"""Copies and near copies of texts."""

from __future__ import annotations

import math
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import char_shingles, once
from threadloom.workspace import Workspace


def exact_groups(df: DataFrame, record: Column, form: Column) -> DataFrame:
    """``form, representative, copies``: distinct texts with the smallest record of each. Null forms are left out."""
    return df.select(record.alias("record"), form.alias("form")).where("form is not null").groupBy("form").agg(F.min("record").alias("representative"), F.count_distinct("record").alias("copies"))


def shingle_frequency(texts: DataFrame, size: int, min_chars: int) -> DataFrame:
    """``shingle, df``: in how many distinct texts of at least ``min_chars`` a shingle occurs."""
    return texts.where(F.length("form") >= min_chars).select(F.explode(char_shingles(F.col("form"), size)).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))


def rare_shingles(texts: DataFrame, size: int, min_chars: int, keys: int, max_block: int) -> DataFrame:
    """``representative, shingle, df``: the ``keys`` rarest shingles of every text that 2 to ``max_block`` texts share. No text travels with them."""
    rows = texts.where(F.length("form") >= min_chars).select("representative", F.explode(char_shingles(F.col("form"), size)).alias("shingle"))
    df = rows.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df").between(2, max_block))
    rank = F.row_number().over(Window.partitionBy("representative").orderBy("df", "shingle"))
    # The planner does not count what explode adds, and would broadcast rows a hundred times its estimate: the join is told to shuffle.
    return rows.hint("merge").join(df, "shingle").withColumn("_rank", rank).where(F.col("_rank") <= keys).select("representative", "shingle", "df")


def candidates(texts: DataFrame, size: int = 4, min_chars: int = 24, keys: int = 4, max_block: int = 100, threshold: float = 0.92) -> DataFrame:
    """``left_id, right_id, left_form, right_form``: pairs of texts that share a rare shingle and whose lengths are near enough.

    Pairs of a block number at most ``max_block`` squared halves, by the frequency band, which loses pairs that share common shingles only.
    :func:`near_pairs` finds all near pairs, without a band. Pairs of ids are made distinct before texts join them.
    """
    rare = rare_shingles(texts, size, min_chars, keys, max_block).select("representative", "shingle")
    a, b = rare.withColumnRenamed("representative", "_a"), rare.withColumnRenamed("representative", "_b")
    pairs = a.join(b, "shingle").where("_a < _b").select("_a", "_b").distinct()
    x, y = (texts.select(F.col("representative").alias(k), F.col("form").alias(f"{k}_form")) for k in ("_a", "_b"))
    both = pairs.join(x, "_a").join(y, "_b")
    short, long = F.least(F.length("_a_form"), F.length("_b_form")), F.greatest(F.length("_a_form"), F.length("_b_form"))
    first = F.col("_a_form") < F.col("_b_form")
    pick = lambda p, q, n: F.when(first, F.col(p)).otherwise(F.col(q)).alias(n)
    return both.where(short >= threshold * long).select(pick("_a", "_b", "left_id"), pick("_b", "_a", "right_id"), pick("_a_form", "_b_form", "left_form"), pick("_b_form", "_a_form", "right_form"))


def _letters(forms: list[str], classes: int = 64, most: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters in unary, so that a product of two rows is the number of characters in common, and what goes beyond ``most`` of a class."""
    counts = np.zeros((len(forms), classes), dtype=np.int32)
    for i, t in enumerate(forms):
        counts[i] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) % classes, minlength=classes)
    capped = np.minimum(counts, most)
    return (capped[:, :, None] > np.arange(most)).reshape(len(forms), -1).astype(np.float32), (counts - capped).sum(axis=1)


def _common_subsequence(places: dict[str, int], n: int, b: str) -> int:
    """Length of the longest common subsequence of ``b`` and the text of ``n`` characters whose places are given as bits."""
    full = (1 << n) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _tile(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """All near pairs of the two sides of a tile; a side of 2 stands on both."""
    slack = 1e-9

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["_side"] != 1], rows[rows["_side"] != 0]
        own = bool((rows["_side"] == 2).any())
        af, bf, ai, bi = a["form"].tolist(), b["form"].tolist(), a["representative"].tolist(), b["representative"].tolist()
        out: list[tuple[str, str, float]] = []
        if af and bf:
            step = 1024
            bl = np.array([len(t) for t in bf])
            right = [(j, *_letters(bf[j : j + step])) for j in range(0, len(bf), step)]
            for i in range(0, len(af), step):
                x, more = _letters(af[i : i + step])
                al = np.array([len(t) for t in af[i : i + step]])
                for j, y, rest in right:
                    if own and j + step <= i:
                        continue
                    l, r = al[:, None], bl[None, j : j + step]
                    # Common characters, then the longest common subsequence, bound the matched characters from above.
                    bound = x @ y.T + np.minimum(more[:, None], rest[None, :])
                    near = (2 * bound >= (threshold - slack) * (l + r)) & (np.minimum(l, r) >= threshold * np.maximum(l, r) - slack)
                    last, places = -1, {}
                    for p, q in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                        if own and j + q <= i + p:
                            continue
                        s, t = af[i + p], bf[j + q]
                        if p != last:
                            last, places = p, {}
                            for at, c in enumerate(s):
                                places[c] = places.get(c, 0) | 1 << at
                        if s == t or 2 * _common_subsequence(places, len(s), t) < (threshold - slack) * (len(s) + len(t)):
                            continue
                        (s, left), (t, other) = sorted(((s, ai[i + p]), (t, bi[j + q])))
                        ratio = SequenceMatcher(None, s, t, autojunk=False).ratio()
                        if ratio >= threshold:
                            out.append((left, other, ratio))
        return pd.DataFrame(out, columns=["left_id", "right_id", "similarity"])

    return run


def near_pairs(texts: DataFrame, threshold: float = 0.92, min_chars: int = 24, tile: int = 4096) -> DataFrame:
    """``left_id, right_id, similarity`` of all pairs of texts with a matched ratio and a ratio of lengths of at least ``threshold``; left is the smaller text.

    Exact, without a band of frequencies: texts of near lengths meet in tiles of about ``tile`` by ``tile``, where bounds from above
    (common characters by a matrix product, then the longest common subsequence) leave few pairs to match. No pair is emitted before it
    is matched, but the bounds are worked out for all pairs of near lengths: time grows with the square of the texts of one length.
    """
    rows = texts.where(F.length("form") >= max(1, min_chars)).select("representative", "form", F.floor(F.log(F.length("form").cast("double")) / math.log(1.0001 / threshold)).cast("int").alias("_b"))
    counts = {r["_b"]: -(-r["count"] // tile) for r in rows.groupBy("_b").count().collect()}
    parts = F.create_map(*[F.lit(k) for pair in (counts or {0: 0}).items() for k in pair])

    def slots(shift: int) -> Column:
        n = F.coalesce(parts[F.col("_b") + shift], F.lit(0))
        return F.filter(F.sequence(F.lit(0), n), lambda y: y < n)

    def cell(b1: Column, p1: Column, b2: Column, p2: Column, side: Column) -> Column:
        return F.struct(b1.alias("_b1"), p1.alias("_p1"), b2.alias("_b2"), p2.alias("_p2"), side.alias("_side"))

    b, x = F.col("_b"), F.col("_part")
    cells = F.concat(
        F.transform(slots(0), lambda y: cell(b, F.least(x, y), b, F.greatest(x, y), F.when(x == y, 2).when(x < y, 0).otherwise(1))),
        F.transform(slots(1), lambda y: cell(b, x, b + 1, y, F.lit(0))),
        F.transform(slots(-1), lambda y: cell(b - 1, y, b, x, F.lit(1))),
    )
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("form"), parts[F.col("_b")]).cast("int"))
    rows = rows.select("representative", "form", F.inline(cells))
    kind = dict(texts.dtypes)["representative"]
    return rows.groupBy("_b1", "_p1", "_b2", "_p2").applyInPandas(_tile(threshold), f"left_id {kind}, right_id {kind}, similarity double")


def word_shingles(text: Column, words: int = 5) -> Column:
    """Distinct hashes of all runs of ``words`` words, sorted; none for shorter texts."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)

    def runs(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1)))
        hashes = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))
        return F.when(F.size(w) >= words, F.array_sort(F.array_distinct(hashes))).otherwise(F.array().cast("array<bigint>"))

    return once(tokens, runs)


def jaccard_pairs(df: DataFrame, record: Column, text: Column, threshold: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Exact set-similarity join on word shingles: (pairs of class representatives with similarity, membership).

    Records with the same set of shingles form a class, named by its smallest record; ``membership`` is ``record_id, class_id``.
    Pairs come from prefix filtering: with shingles ordered from rare to common, two sets of similarity ``t`` share one of
    their first ``n - ceil(t n) + 1`` shingles, so common shingles meet only where no rarer one can. No pair is lost and no
    bucket is capped. Every record has a class: texts of fewer words than a shingle, null and empty ones too, share one with texts of the same
    words, and have no partners beyond it.
    """
    work = Workspace(df.sparkSession, "jaccard")
    # A text of fewer words has no shingles: its words themselves are its key, so equal short texts are one class.
    few = F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")
    rows = df.select(record.alias("record_id"), F.coalesce(word_shingles(text, words), F.array().cast("array<bigint>")).alias("s"), few.alias("_few"))
    keyed = rows.select("record_id", F.sha2(F.when(F.size("s") > 0, F.array_join(F.col("s").cast("array<string>"), ",")).otherwise(F.concat(F.lit("few:"), "_few")), 256).alias("_k"), "s")
    keyed = work.save(keyed)
    classes = keyed.groupBy("_k").agg(F.min_by("s", "record_id").alias("s"), F.min("record_id").alias("class_id"))
    membership = keyed.select("record_id", "_k").join(classes.select("_k", "class_id"), "_k").select("record_id", "class_id")
    sets = work.save(classes.where("size(s) > 0").select("class_id", "s", F.size("s").alias("n")))
    exploded = sets.select("class_id", "n", F.explode("s").alias("h"))
    frequency = exploded.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle of one class only can match nothing, but it still takes a place in the prefix: it is the rarest.
    shared = exploded.join(frequency, "h")
    order = Window.partitionBy("class_id").orderBy("df", "h")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("class_id"))
    prefix = shared.withColumn("_place", F.row_number().over(order) + alone).where(F.col("_place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("class_id", "n", "h")
    a, b = prefix.select("h", F.col("class_id").alias("left_id"), F.col("n").alias("ln")), prefix.select("h", F.col("class_id").alias("right_id"), F.col("n").alias("rn"))
    pairs = a.join(b, "h").where((F.col("left_id") < F.col("right_id")) & (F.least("ln", "rn") >= threshold * F.greatest("ln", "rn"))).select("left_id", "right_id").distinct()
    x, y = sets.select(F.col("class_id").alias("left_id"), F.col("s").alias("ls")), sets.select(F.col("class_id").alias("right_id"), F.col("s").alias("rs"))
    both = pairs.join(x, "left_id").join(y, "right_id").select("left_id", "right_id", F.size(F.array_intersect("ls", "rs")).alias("_i"), (F.size("ls") + F.size("rs")).alias("_t"))
    found = both.withColumn("similarity", F.col("_i") / (F.col("_t") - F.col("_i"))).where(F.col("similarity") >= threshold).select("left_id", "right_id", "similarity")
    return found, membership
