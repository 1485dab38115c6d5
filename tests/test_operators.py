"""Similarity, splits, samples, search, labels and positions."""

import datetime as dt
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import labels, retrieval, sampling, similarity, splitting
from threadloom.operators.ranking import rank_within, running_total


def test_running_total_and_ranks(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, id int").withColumn("pos", F.lit("old"))
    got = {x.id: x.pos for x in rank_within(df, "g", [F.col("o"), F.col("id")], "pos", partitions=7).collect()}
    for g in ("a", "b", None):
        mine = sorted((o, i) for k, o, i in rows if k == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    total = {x.id: x.t for x in running_total(df, "g", [F.col("o"), F.col("id")], F.col("o"), "t", partitions=5).collect()}
    at = 0
    for o, i in sorted((o, i) for k, o, i in rows if k == "a"):
        at += o
        assert total[i] == at
    assert rank_within(df.limit(0), "g", [F.col("o")]).count() == 0


def test_jaccard_is_exact(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(30):
        base = [r.choice(words) for _ in range(40)]
        texts.append(base)
        for _ in range(2):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2])):
                copy[r.randrange(40)] = r.choice(words)
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "only four words here"), (903, "Only four WORDS, here"), (904, "four")]
    pairs, members = similarity.jaccard_pairs(spark.createDataFrame(rows, "id int, t string"), F.col("id"), F.col("t"), 0.6)
    sets = {i: {tuple(t[k : k + 5]) for k in range(36)} for i, t in enumerate(texts)}
    cls = {x.record_id: x.class_id for x in members.collect()}
    # Texts of fewer than five words are classes by their words, without partners.
    assert cls == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets} | {900: 900, 901: 900, 902: 902, 903: 902, 904: 904}
    want = {(a, b) for a in set(cls.values()) & set(sets) for b in set(cls.values()) & set(sets) if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert want and {(x.left_id, x.right_id) for x in pairs.collect()} == want


def test_near_pairs(spark):
    rows = [("e1", "the app crashes whenever i open settings"), ("e2", "the app crashes whenever i open the settings"), ("e3", "nothing in common with others at all here"), ("e4", "short"), ("e5", "the app crashes whenever i open settings")]
    groups = similarity.exact_groups(spark.createDataFrame(rows, "r string, f string"), F.col("r"), F.col("f"))
    assert {(x.representative, x.copies) for x in groups.collect()} == {("e1", 2), ("e2", 1), ("e3", 1), ("e4", 1)}
    got = similarity.near_pairs(groups, 0.9).collect()
    assert [(x.left_id, x.right_id) for x in got] == [("e1", "e2")] or [(x.left_id, x.right_id) for x in got] == [("e2", "e1")]


def test_near_pairs_of_common_shingles(spark):
    """Blocks above the band: every pair is found, by brute force, in one tile and in many."""
    r = random.Random(5)
    base = "the app keeps crashing whenever i open the settings page on my phone"
    forms = sorted({base[:k] + "".join(r.choice("abcde") for _ in range(n)) + base[k + n :] for k in range(0, 60, 2) for n in (1, 2, 3, 4, 5) for _ in range(2)})
    rows = [(f"e{i:04d}", f) for i, f in enumerate(forms)]
    texts = similarity.exact_groups(spark.createDataFrame(rows, "r string, f string"), F.col("r"), F.col("f"))
    want = {(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.92}
    banded = {(x.left_id, x.right_id) for x in similarity.candidates(texts).collect()}
    assert want - banded
    for tile in (50, 4096):
        got = [(x.left_id, x.right_id) for x in similarity.near_pairs(texts, tile=tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rare_shingles_broadcast_no_exploded_rows(spark, tmp_path):
    """A written table of a few kilobytes has any number of shingles: the planner must not take its size for theirs."""
    rows = [(f"e{i}", f"some words that are shared, and {i * 7919} of their own") for i in range(50)]
    spark.createDataFrame(rows, "representative string, form string").write.parquet(str(tmp_path / "t"))
    got = similarity.rare_shingles(spark.read.parquet(str(tmp_path / "t")), 4, 24, 4, 100)
    assert "Broadcast" not in _planned(got)
    assert {x.representative for x in got.collect()} == {r for r, _ in rows} and max(x.df for x in got.collect()) <= 100


def test_chronological_split(spark):
    day = lambda d: dt.datetime(2017, 10, d)
    minute = dt.timedelta(minutes=1)
    rows = [("a", "g1", day(1)), ("b", "g1", day(9)), ("c", "g2", day(2)), ("d", "g2", day(3))] + [(x, x, day(d)) for x, d in zip("efghijkl", (4, 5, 6, 7, 8, 10, 11, 12), strict=True)]
    data = [(r, g, t, t + minute) for r, g, t in rows] + [("m", "m", None, None)]
    iv = splitting.intervals(spark.createDataFrame(data, "r string, g string, s timestamp, e timestamp"), F.col("r"), F.col("g"), F.col("s"), F.col("e"))
    ends = sorted(t + minute for _, _, t in rows)
    n = len(ends)
    i1 = min(n - 2, max(1, int(n * 0.5)))
    i2 = min(n - 1, max(i1 + 1, int(n * 0.75)))
    cut = splitting.cutoffs(iv, 0.5, 0.25).first()
    assert (cut.train_cutoff, cut.test_cutoff) == (ends[i1], ends[i2])
    got = {x.record_id: (x.split, x.reason) for x in splitting.chronological(iv, 0.5, 0.25).collect()}
    assert got["a"] == got["b"] == ("quarantine", "group_spans_chronological_cutoff")
    assert got["m"] == ("quarantine", "group_contains_unusable_timestamp")
    assert got["c"] == got["d"] == ("train", None) and got["l"][0] == "test"
    assert {x.split for x in splitting.chronological(iv.limit(2), 0.5, 0.25).collect()} == {"quarantine"}
    pool = splitting.chronological(iv, 0.5, 0.25).where("split <> 'quarantine'").join(iv.select("record_id", "start", "end"), "record_id")
    checks = splitting.overlaps(pool, "split", "record_id", "group_id").unionByName(splitting.chronology(pool, "split", "start", "end", ["train", "development", "test"]))
    assert {x["check"]: x.violations for x in checks.collect()} == {"record_id_disjoint": 0, "group_id_disjoint": 0, "strict_chronology": 0}
    leaked = pool.unionByName(pool.where("split = 'train'").withColumn("split", F.lit("test")))
    assert splitting.overlaps(leaked, "split", "group_id").first().violations > 0


def pool(spark):
    texts = ["why", "I was hacked? really?", "refund please, charged twice", "two questions? yes? here is more text", "the app crashes on my phone again today"]
    rows = [(f"example_{i:03d}", f"g{i // 2}", texts[i % 5], ["x"] if i % 3 else []) for i in range(80)]
    return spark.createDataFrame(rows, "example_id string, group_id string, text string, context array<string>")


def test_samples(spark):
    p = pool(spark)
    first = sampling.uniform(p, 20, 42, "n").collect()
    assert first == sampling.uniform(p.repartition(3), 20, 42, "n").collect()
    assert [x.position for x in first] == list(range(1, 21)) and len({x.group_id for x in first}) == 20
    golden = sampling.challenge(p, 15, 10, 42).collect()
    assert len(golden) == 25 and len({x.group_id for x in golden}) == 25 and {x.stratum for x in golden if x.position <= 15} == {"random"}
    strata = sampling.stratified(p, 22, 42).collect()
    assert len(strata) == 22 and len({x.group_id for x in strata}) == 22
    q = sampling.uniform(p, 2, 42, "n")
    more = sampling.extend(q, p, 3, 42, "m").orderBy("position").collect()
    assert [x.example_id for x in more[:2]] == [x.example_id for x in first[:2]] and [x.position for x in more] == [1, 2, 3, 4, 5]
    moved = sampling.pinned(q, q.withColumn("position", F.col("position") + (F.col("position") > 1).cast("int"))).orderBy("position").collect()
    assert [x.moved for x in moved] == [False, True]


def test_tfidf_and_lexical(spark):
    corpus = spark.createDataFrame([(1, "app crash crash", "a"), (2, "billing refund", "b"), (3, "app refund", "c")], "id long, text string, group_id string")
    idf, w = retrieval.fit(corpus.select("id", "text"), 1)
    got = {(x.id, x.term): x.weight for x in w.collect()}
    i = lambda df: math.log(4 / (1 + df)) + 1
    raw = {"app": i(2), "crash": (1 + math.log(2)) * i(1)}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    assert got[(1, "app")] == pytest.approx(raw["app"] / norm) and got[(1, "crash")] == pytest.approx(raw["crash"] / norm)
    assert sum(v * v for (d, _), v in got.items() if d == 2) == pytest.approx(1)
    both = w.join(corpus.select("id", "group_id"), "id")
    q = spark.createDataFrame([(10, "app app", None), (11, "unknown words", None), (12, "refund", "b")], "query_id long, text string, group_id string")
    hits = {(x.query_id, x["rank"]): x.id for x in retrieval.lexical_topk(both, q, idf, 2, 1).collect()}
    assert hits == {(10, 1): 3, (10, 2): 1, (12, 1): 3} or hits == {(10, 1): 1, (10, 2): 3, (12, 1): 3}
    assert [len(t) for t in spark.createDataFrame([("a bc de fg",), ("",)], "t string").select(retrieval.terms(F.col("t"), 3)).toPandas().iloc[:, 0]] == [6, 0]


def test_weights_broadcast_a_small_vocabulary_only(spark, tmp_path, monkeypatch):
    """Exploded terms are never broadcast, whatever the planner takes their size for; the vocabulary only within its bound."""
    spark.createDataFrame([(i, f"some shared words and {i} with {i * 7919} of its own") for i in range(50)], "id long, text string").write.parquet(str(tmp_path / "t"))
    corpus = spark.read.parquet(str(tmp_path / "t"))
    _, small = retrieval.fit(corpus)
    assert "BuildLeft" not in _planned(small) and "BuildRight" in _planned(small)
    monkeypatch.setattr(retrieval, "IDF_BROADCAST_BYTES", 0)
    _, large = retrieval.fit(corpus)
    assert "Broadcast" not in _planned(large)
    a, b = ({(x.id, x.term): x.weight for x in w.collect()} for w in (small, large))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)


def test_lexical_search_broadcasts_no_exploded_terms(spark, tmp_path):
    spark.createDataFrame([(i, f"some shared words and {i} with {i * 7919} of its own", f"g{i % 3}") for i in range(50)], "id long, text string, group_id string").write.parquet(str(tmp_path / "t"))
    corpus = spark.read.parquet(str(tmp_path / "t"))
    idf, w = retrieval.fit(corpus.select("id", "text"))
    q = corpus.where("id % 10 = 0").select(F.col("id").alias("query_id"), "text", "group_id")
    out = retrieval.lexical_topk(w.join(corpus.select("id", "group_id"), "id"), q, idf, 3)
    # Left sides are exploded terms; what is broadcast, on the right, is the vocabulary and one row per document.
    assert "BuildLeft" not in _planned(out)
    assert {(x.query_id, x["rank"]) for x in out.collect()} == {(i, k) for i in range(0, 50, 10) for k in (1, 2, 3)}


def test_lexical_search_shuffles_no_pairs_of_terms(spark, tmp_path):
    """What is left to rank is the best of each task: no join of equal terms, few rows. Ids in several groups are summed over them."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["aa", "bb", "cc", "dd", f"w{r.randrange(60)}"]) for _ in range(r.randrange(1, 12))), r.choice(["g1", "g2", "g3", None])) for i in range(300)]
    rows += [(i, "aa w1 w2", g) for i, g in ((400, "g1"), (400, "g2"), (410, "g1"), (410, "g1"), (420, None), (421, "g9"), (430, "g9"))]
    spark.createDataFrame(rows, "id long, text string, group_id string").write.parquet(str(tmp_path / "t"))
    corpus = spark.read.parquet(str(tmp_path / "t"))
    idf, w = retrieval.fit(corpus.select("id", "text"))
    q = corpus.where("id % 10 = 0").select(F.col("id").alias("query_id"), "text", "group_id")
    out = retrieval.lexical_topk(w.join(corpus.select("id", "group_id"), "id"), q, idf, 3)
    assert "Join" not in _planned(out)
    weights = {}
    for x in w.collect():
        weights.setdefault(x.id, {})[x.term] = x.weight
    groups = {}
    for i, _, g in rows:
        groups.setdefault(i, []).append(g)
    want = set()
    for a in (i for i in weights if i % 10 == 0):
        score = {b: sum(v * weights[b].get(t, 0) for t, v in weights[a].items()) * sum(g is None or h is None or g != h for g in groups[a] for h in groups[b]) for b in weights}
        best = sorted(((-round(s, 8), b) for b, s in score.items() if round(s, 8) > 0))[:3]
        want |= {(a, b, n + 1, round(-s, 6)) for n, (s, b) in enumerate(best)}
    assert {(x.query_id, x.id, x["rank"], round(x.score, 6)) for x in out.collect()} == want


def test_more_texts_are_counted_in_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id", "concat('text ', uuid()) AS text").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    few = retrieval._counts(texts, 2)
    monkeypatch.setattr(retrieval, "TEXT_BYTES", 100)
    many = retrieval._counts(texts, 2)
    assert many.rdd.getNumPartitions() == 32 >= 8 * few.rdd.getNumPartitions()
    assert not few.exceptAll(many).count() and few.count() == many.count()


def test_best_of_blocks(monkeypatch):
    """The best so far, block after block, are those of all rows: common terms and others, ties by id, few terms as matrices or none."""
    r = random.Random(7)

    def block(first, n):
        sparse = [{t: r.random() for t in {int(60 * r.random() ** 3) for _ in range(r.randrange(1, 12))}} if i % 4 else {1: 0.5, 2: 0.5} for i in range(n)]
        packed = [np.array([t for s in sparse for t in s], "<i4").tobytes(), np.array([v for s in sparse for v in s.values()], "<f8").tobytes()]
        groups = [r.choice(["a", "b", None]) for _ in range(n)]
        return list(zip(range(first, first + n), groups, sparse, strict=True)), retrieval._Rows(list(range(first, first + n)), groups, [False] * n, np.array([len(s) for s in sparse], "<i4").tobytes(), *packed)

    for common, entries in ((4096, 1 << 20), (3, 50), (0, 7)):
        monkeypatch.setattr(retrieval, "COMMON_TERMS", common)
        monkeypatch.setattr(retrieval, "AT_ONCE", entries)
        asked, cols = block(1000, 20)
        best, seen = {}, []
        for at in range(0, 200, 40):
            plain, rows = block(at, 40)
            seen += plain
            assert not list(retrieval._best(best, rows, cols, 3))
        ((keys, j, ids, _),) = best.values()
        for n, (a, g, x) in enumerate(asked):
            score = {b: round(sum(v * y.get(t, 0) for t, v in x.items()), 8) for b, h, y in seen if g is None or h is None or g != h}
            assert keys[n] == a and ids[j == n].tolist() == sorted((b for b, s in score.items() if s > 0), key=lambda b: (-score[b], b))[:3]


def test_dense(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(70, [0.0] * 8), (71, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    got = {(x.query_id, x["rank"]): x.id for x in retrieval.dense_topk(df, df.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 3, -1.0, block=2).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for q in (0, 20, 40):
        best = sorted((i for i, v in rows[:60] if i != q), key=lambda i: (-cos(rows[q][1], rows[i][1]), i))[:3]
        assert [got[(q, k)] for k in (1, 2, 3)] == best


def test_labels(spark):
    events = spark.createDataFrame([("a", 1, 1, "failure"), ("a", 2, 2, "success"), ("a", 3, 3, "failure"), ("b", 4, 2, "failure")], "k string, o int, attempt int, status string")
    assert {(x.k, x.o) for x in labels.latest(events, "k", "o").collect()} == {("a", 3), ("b", 4)}
    got = labels.attempt_violations(events, "k", "attempt", F.col("status") == "success", "o").collect()
    assert {(x.k, x.o, x.violation) for x in got} == {("a", 3, "after_success"), ("b", 4, "not_contiguous")}
    chosen = spark.createDataFrame([("a", 2, 1, "run"), ("a", 1, 5, "human"), ("b", 3, 1, "run")], "k string, priority int, o int, who string")
    assert {(x.k, x.who) for x in labels.prioritised(chosen, "k", "priority", "o").collect()} == {("a", "human"), ("b", "run")}
    ledger = spark.createDataFrame([("m", t * 1_000_000, c) for t, c in ((0, 40), (59, 40), (60, 1), (119, 1))], "g string, us long, c long")
    assert [(x.us // 1_000_000, x.cost_minute) for x in labels.rolling(ledger, "g", "us", "c", {"minute": 60}).orderBy("us").collect()] == [(0, 40), (59, 80), (60, 41), (119, 2)]


def test_metrics(spark):
    rows = spark.createDataFrame([("x", "x", False, False), ("x", "y", True, False)], "truth string, predicted string, should boolean, proposed boolean")
    assert labels.intent_metrics(rows).first().accuracy == 0.5
    m = labels.escalation_metrics(rows).first()
    assert (m.missed_rate, m.unsafe_rate, m.precision, m.recall) == (1.0, 0.5, 0.0, 0.0)
    none = labels.escalation_metrics(rows.limit(0)).first()
    assert none.total == 0 and none.coverage == 0.0
    assert labels.majority(spark.createDataFrame([("b",), ("a",), (None,)], "l string"), "l").first().label == "a"
