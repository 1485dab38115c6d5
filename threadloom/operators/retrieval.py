"""TF-IDF weights, lexical and dense search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import once
from threadloom.workspace import Workspace, fits, stored_bytes

#: A vocabulary is broadcast up to this size in memory.
IDF_BROADCAST_BYTES = 32 << 20
#: Stored bytes of texts whose terms a task counts.
TEXT_BYTES = 1 << 19
#: Rows and entries of a block of sparse rows, terms that are multiplied as matrices, and pairs of entries that are multiplied at once.
BLOCK_ROWS, BLOCK_ENTRIES, COMMON_TERMS, AT_ONCE = 1024, 1 << 18, 4096, 1 << 18
#: Bytes of blocks that go to Python at once, and of written blocks of queries that a task holds.
SENT_BYTES, HELD_BYTES = 4 << 20, 32 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def terms(text: Column, ngrams: int = 2) -> Column:
    """Words of at least two letters or digits, lower case, and runs of up to ``ngrams`` of them."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b\w\w+\b)"), 1)
    return once(words, lambda w: F.concat(w, *[_runs(w, n) for n in range(2, ngrams + 1)]))


def _runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks; none if there are fewer words. A lambda of two arguments would be given the index."""
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def fit(corpus: DataFrame, ngrams: int = 2, max_features: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``term, idf``, ``id, term, weight``) of a corpus ``id, text``: sublinear term counts, smoothed idf, unit length rows.

    ``tf = 1 + ln(count)``, ``idf = ln((1 + n) / (1 + df)) + 1``. The vocabulary is the ``max_features`` terms of most occurrences, ties by term.
    """
    counts = _counts(corpus, ngrams)
    vocabulary = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(max_features)
    size = corpus.agg(F.count("*").alias("docs"))
    idf = vocabulary.crossJoin(F.broadcast(size)).select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = Workspace(corpus.sparkSession, "idf").save(idf)
    return idf, weigh(counts, idf)


def _counts(texts: DataFrame, ngrams: int) -> DataFrame:
    """``id, term, n`` of ``id, text``: texts move to the task of their id, terms no more. A task counts in memory, so more texts take more tasks."""
    texts = texts.select("id", "text")
    usual = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Up to eight times the usual number: the planner's size of a join may be far too large.
    tasks = min(stored_bytes(texts) // TEXT_BYTES, 8 * usual)
    return (texts.repartition(tasks, "id") if tasks > usual else texts.repartition("id")).select("id", F.explode(terms(F.col("text"), ngrams)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def weigh(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """``id, term, weight`` of ``id, term, n``, rows of unit length. An ``idf`` of small size, as written, is broadcast; any other join is told to
    shuffle, since the planner does not count what explode adds and would broadcast all counts."""
    both = counts.join(F.broadcast(idf), "term") if fits(idf, IDF_BROADCAST_BYTES) else counts.hint("merge").join(idf, "term")
    raw = both.select("id", "term", ((1 + F.log("n")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight"))


def lexical_topk(weights: DataFrame, queries: DataFrame, idf: DataFrame, k: int = 3, ngrams: int = 2) -> DataFrame:
    """``query_id, id, score, rank``: for each query ``query_id, text, group_id`` the ``k`` rows of highest cosine above 0, ties by id.

    ``weights`` needs ``id, group_id, term, weight``, weights above 0; rows of the query's own group are left out before ranking. Every query
    meets every row, exactly: both sides are packed into blocks of sparse rows, a pair of blocks is multiplied in one task, which keeps its best
    ``k`` per query, so neither pairs of equal terms nor sums are ever rows of a shuffle. No block is broadcast or passes through the driver. The
    best of each task are written here, since the bytes of a batch are a setting of the session.
    """
    import pandas as pd

    spark = weights.sparkSession
    work = Workspace(spark, "search")
    counts = _counts(queries.select(F.col("query_id").alias("id"), "text"), ngrams)
    q = work.save(weigh(counts, idf).join(queries.select(F.col("query_id").alias("id"), "group_id"), "id"))
    # Numbers from 0 without gaps, so given in one task; a row per term of the queries.
    numbers = work.save(q.select("term").distinct().coalesce(1).select("term", F.monotonically_increasing_id().cast("int").alias("no")))
    asked = work.save(_sparse(q, numbers, "q"))
    held = 1 + stored_bytes(asked) // HELD_BYTES
    pairs = _sparse(weights, numbers, "r").crossJoin(asked.coalesce(held).hint("shuffle_replicate_nl"))

    def scan(batches):  # noqa: ANN001, ANN202
        best: dict = {}
        for batch in batches:
            for x in batch.to_dict("records"):
                rows, cols = (_Rows(*(x[f"{side}_{part}"] for part in _Rows.PARTS)) for side in "rq")
                yield from _best(best, rows, cols, k)
        for keys, j, ids, score in best.values():
            yield pd.DataFrame({"query_id": keys[j], "id": ids, "score": score})

    kinds = dict(weights.dtypes)["id"], dict(queries.dtypes)["query_id"]
    conf, before = spark.conf, spark.conf.get(_BATCH_BYTES, None)
    conf.set(_BATCH_BYTES, str(SENT_BYTES))
    try:
        found = work.save(pairs.mapInPandas(scan, f"query_id {kinds[1]}, id {kinds[0]}, score double"))
    finally:
        conf.unset(_BATCH_BYTES) if before is None else conf.set(_BATCH_BYTES, before)
    work.drop(q, numbers, asked)
    # Rounded, so that equal scores are ties whatever the order of the sum.
    scores = found.groupBy("query_id", "id").agg(F.round(F.sum("score"), 8).alias("score")).where("score > 0")
    return _top(scores, k)


def _sparse(rows: DataFrame, numbers: DataFrame, prefix: str) -> DataFrame:
    """Rows ``id, group_id, term, weight`` as blocks of sparse rows, one row per id and group; terms without a number are left out."""
    import numpy as np
    import pandas as pd

    numbers = F.broadcast(numbers) if fits(numbers, IDF_BROADCAST_BYTES) else numbers.hint("merge")
    kept = rows.where("id is not null").select("id", F.col("group_id").cast("string").alias("group_id"), "term", "weight").join(numbers, "term")
    units = kept.groupBy("id", "group_id").agg(F.collect_list("no").alias("nos"), F.collect_list("weight").alias("weights"))
    units = units.withColumn("many", F.count("*").over(Window.partitionBy("id")) > 1)

    def pack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            sizes = batch["nos"].map(len).to_numpy()
            ends, at = np.cumsum(sizes), 0
            while at < len(batch):
                most = np.searchsorted(ends, ends[at] - sizes[at] + BLOCK_ENTRIES, "right")
                to = int(min(at + BLOCK_ROWS, max(at + 1, most)))
                part = batch.iloc[at:to]
                nos, weights = (np.concatenate(part[c].to_numpy()).astype(kind).tobytes() for c, kind in (("nos", "<i4"), ("weights", "<f8")))
                cells = part["id"].tolist(), part["group_id"].tolist(), part["many"].tolist(), sizes[at:to].astype("<i4").tobytes(), nos, weights
                yield pd.DataFrame({f"{prefix}_{name}": [cell] for name, cell in zip(_Rows.PARTS, cells, strict=True)})
                at = to

    kinds = f"array<{dict(units.dtypes)['id']}>", "array<string>", "array<boolean>", "binary", "binary", "binary"
    return units.mapInPandas(pack, ", ".join(f"{prefix}_{name} {kind}" for name, kind in zip(_Rows.PARTS, kinds, strict=True)))


class _Rows:
    """A block of sparse rows."""

    PARTS = "keys", "groups", "many", "sizes", "nos", "weights"

    def __init__(self, keys, groups, many, sizes: bytes, nos: bytes, weights: bytes):  # noqa: ANN001
        import numpy as np

        self.keys, self.groups, self.many = np.asarray(keys), np.asarray(groups, dtype=object), np.asarray(many, dtype=bool)
        self.sizes, self.nos, self.weights = np.frombuffer(sizes, "<i4").astype("int64"), np.frombuffer(nos, "<i4"), np.frombuffer(weights, "<f8")
        self.row, self.start = np.repeat(np.arange(len(self.sizes)), self.sizes), np.cumsum(self.sizes) - self.sizes
        self.norm = np.sqrt(np.bincount(self.row, self.weights**2).max())


def _best(best: dict, rows: _Rows, cols: _Rows, k: int):  # noqa: ANN202
    """Brings ``best`` up to date: by block of queries their keys and, of the best ``k`` rows so far, place of the query, id and score. Yields what
    can't be ranked here: scores of ids that are in several groups, which are summed over them.

    Products of single precision find what may be among the best, within a bound of their error; its scores are then summed in double precision.
    """
    import numpy as np
    import pandas as pd

    n, m = len(rows.keys), len(cols.keys)
    near = _products(rows, cols)
    slack = (min(rows.sizes.max(), cols.sizes.max()) + 8) * np.finfo("float32").eps * 2 * rows.norm * cols.norm
    codes = pd.factorize(np.concatenate([rows.groups, cols.groups]))[0]
    near[(codes[:n, None] == codes[None, n:]) & (codes[:n, None] >= 0)] = 0
    if rows.many.any() or cols.many.any():
        i, j = np.nonzero((rows.many[:, None] | cols.many[None, :]) & (near > 0))
        yield pd.DataFrame({"query_id": cols.keys[j], "id": rows.keys[i], "score": _exact(rows, cols, i, j)})
        near[rows.many] = 0
        near[:, cols.many] = 0
    block = cols.keys[0], cols.groups[0]
    _, had, ids, scores = best.get(block, (cols.keys, np.empty(0, dtype=int), rows.keys[:0], np.empty(0)))
    least = np.full(m, np.inf)
    np.minimum.at(least, had, scores)
    least -= slack + 1e-8
    short = np.flatnonzero(np.bincount(had, minlength=m) < k)
    if len(short):
        least[short] = np.partition(near[:, short], n - min(k, n), axis=0)[n - min(k, n)] - 2 * slack
    i, j = np.nonzero((near > 0) & (near >= least))
    j, ids, scores = np.concatenate([had, j]), np.concatenate([ids, rows.keys[i]]), np.concatenate([scores, _exact(rows, cols, i, j)])
    # As they are ranked in the end: by rounded score, then id.
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -np.floor(scores * 1e8 + 0.5), j))
    first = np.searchsorted(j[order], np.arange(m))
    order = order[np.arange(len(order)) - first[j[order]] < k]
    best[block] = cols.keys, j[order], ids[order], scores[order]


def _products(rows: _Rows, cols: _Rows):  # noqa: ANN202
    """Products of all rows of two blocks, single precision: common terms by a product of matrices, the others by their pairs of entries."""
    import numpy as np

    n, m, width = len(rows.keys), len(cols.keys), 1 + max(rows.nos.max(), cols.nos.max())
    per = np.bincount(cols.nos, minlength=width)
    both = np.bincount(rows.nos, minlength=width) * per
    common = np.flatnonzero(both * 1024 > n * m)
    common = common[np.argsort(-both[common])[:COMMON_TERMS]]
    at = np.full(width, -1)
    at[common] = np.arange(len(common))

    def matrix(x: _Rows):  # noqa: ANN202
        out, place = np.zeros(len(x.keys) * len(common), dtype="float32"), at[x.nos]
        known = place >= 0
        np.add.at(out, x.row[known] * len(common) + place[known], x.weights[known].astype("float32"))
        return out.reshape(len(x.keys), len(common))

    out = matrix(rows) @ matrix(cols).T
    flat = out.reshape(-1)
    right = np.flatnonzero(at[cols.nos] < 0)
    right = right[np.argsort(cols.nos[right], kind="stable")]
    first = np.searchsorted(cols.nos[right], np.arange(width))
    left = np.flatnonzero((at[rows.nos] < 0) & (per[rows.nos] > 0))
    times = per[rows.nos[left]]
    ends, begin = np.cumsum(times), 0
    while begin < len(left):
        end = int(max(begin + 1, np.searchsorted(ends, ends[begin] - times[begin] + AT_ONCE, "right")))
        part, reps = left[begin:end], times[begin:end]
        j = right[_ranges(first[rows.nos[part]], reps)]
        np.add.at(flat, np.repeat(rows.row[part] * m, reps) + cols.row[j], (np.repeat(rows.weights[part], reps) * cols.weights[j]).astype("float32"))
        begin = end
    return out


def _exact(rows: _Rows, cols: _Rows, i, j):  # noqa: ANN001, ANN202
    """Products of rows ``i`` and ``j``, pair by pair, in double precision."""
    import numpy as np

    out, query = np.empty(len(i)), np.zeros(1 + max(rows.nos.max(), cols.nos.max()))
    order = np.argsort(j, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(j[order])) + 1) if len(order) else []:
        own = slice(at := cols.start[j[part[0]]], at + cols.sizes[j[part[0]]])
        np.add.at(query, cols.nos[own], cols.weights[own])
        sizes = rows.sizes[i[part]]
        entries = _ranges(rows.start[i[part]], sizes)
        out[part] = np.add.reduceat(query[rows.nos[entries]] * rows.weights[entries], np.cumsum(sizes) - sizes)
        query[cols.nos[own]] = 0
    return out


def _ranges(starts, sizes):  # noqa: ANN001, ANN202
    """The places ``start, start + 1, ...`` of every range, one after the other."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def unit(vector: Column) -> Column:
    """A vector of length one; null for a zero vector or one that is not finite."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    fine = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(fine, F.transform(vector, lambda x: x.cast("double") / norm))


def _packed(rows: DataFrame, key: str, block: int, prefix: str) -> DataFrame:
    """Rows ``key, vector`` packed by ``block``: an array of keys and their vectors as one matrix of bytes."""
    import numpy as np
    import pandas as pd

    def pack(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                yield pd.DataFrame({f"{prefix}_keys": [part[key].tolist()], f"{prefix}_matrix": [np.stack(part["vector"].to_numpy()).astype("<f8").tobytes()]})

    return rows.select(key, "vector").mapInPandas(pack, f"{prefix}_keys array<{dict(rows.dtypes)[key]}>, {prefix}_matrix binary")


def dense_topk(index: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.2, block: int = 512) -> DataFrame:
    """``query_id, id, score, rank``: for each query ``query_id, vector`` the ``k`` rows ``id, vector`` of highest cosine, at least ``least``.

    A stated query set against all rows, exact and in blocks: both sides are packed into matrices, every pair of blocks is one matrix product,
    and each keeps its best ``k`` per query before the shuffle. The planner broadcasts the blocks of queries only if they are small; nothing
    passes through the driver. A row is never its own hit; vectors that are zero or not finite have no hits.
    """
    import numpy as np
    import pandas as pd

    rows = _packed(index.select("id", unit(F.col("vector")).alias("vector")).where("vector is not null"), "id", 2048, "r")
    asked = _packed(queries.select("query_id", unit(F.col("vector")).alias("vector")).where("vector is not null"), "query_id", block, "q")

    def scan(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for own, left, names, right in zip(batch["r_keys"], batch["r_matrix"], batch["q_keys"], batch["q_matrix"], strict=True):
                own, names = np.asarray(own), np.asarray(names)
                scores = np.frombuffer(left, dtype="<f8").reshape(len(own), -1) @ np.frombuffer(right, dtype="<f8").reshape(len(names), -1).T
                scores[own[:, None] == names[None, :]] = -2.0
                kept = min(k, len(own))
                # Ties at the edge are kept whole, so the rank below decides them by id.
                edge = np.partition(scores, len(own) - kept, axis=0)[len(own) - kept]
                i, j = np.nonzero((scores >= edge) & (scores >= least))
                yield pd.DataFrame({"query_id": names[j], "id": own[i], "score": scores[i, j]})

    found = rows.crossJoin(asked).mapInPandas(scan, f"query_id {dict(queries.dtypes)['query_id']}, id {dict(index.dtypes)['id']}, score double")
    return _top(found, k)


def _top(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
