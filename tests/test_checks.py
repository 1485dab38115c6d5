"""Validators, label logs, evaluation, classifier, settings and caches on small tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators import evaluation, extraction, label_log, sampling, validators
from threadloom.operators.models import Blocked, IntentModel
from threadloom.operators.validators import ChecksFailed, require
from threadloom.sources import cache, files, settings


def got(df, *keys):
    return {tuple(r[k] for k in keys[:-1]) if len(keys) > 2 else r[keys[0]]: r[keys[-1]] for r in df.collect()}


def test_eligibility(spark):
    messages = spark.createDataFrame([(1, "c", True, None), (2, "us", False, 1), (3, "us", False, 9), (4, "them", False, 1), (5, "us", None, 1)], "id long, author string, inbound boolean, parent long")
    rows = [("ok", 1, "hi", [2], [], []), ("far", 1, "hi", [3], [], []), ("other", 1, "hi", [2, 4], [], []), ("none", 1, " ​", None, None, None), ("gone", 7, "hi", [8], [], ["cyclic_relationships"]), ("side", 2, "hi", [5], [], ["cross_brand_ambiguous"]), ("future", 1, "hi", [2], [2], [])]
    df = spark.createDataFrame([(a, "t" if a != "far" else "x", b, c, d, e, f) for a, b, c, d, e, f in rows], "example_id string, thread_id string, customer long, text string, replies array<long>, context array<long>, flags array<string>").withColumn("inbound", F.lit("clash"))
    threads = spark.createDataFrame([("t", []), ("x", ["cross_brand_ambiguous"])], "thread_id string, flags array<string>")
    reasons = got(validators.eligibility(df, messages, threads, "us"), "example_id", "reasons")
    assert reasons == {
        "ok": [], "far": ["cross_brand_ambiguous", "invalid_customer_brand_pairing"], "other": ["invalid_customer_brand_pairing"], "none": ["missing_customer_text", "missing_reference_reply"],
        "gone": ["invalid_customer_brand_pairing", "invalid_customer_record", "unresolved_relationship_conflict"], "side": ["cross_brand_ambiguous", "invalid_customer_brand_pairing", "invalid_customer_record"], "future": ["future_reply_in_input"],
    }
    assert validators.eligibility(df.limit(0), messages, threads, "us").count() == 0


def test_disjoint_subset_and_require(spark):
    rows = [("a", "1", ["x", "y"]), ("a", "2", ["z", None]), ("b", "2", ["x"]), ("b", None, []), ("c", None, None)]
    pools = spark.createDataFrame(rows, "split string, id string, m array<string>")
    checks = validators.disjoint(pools, "split", ["a", "b", "c"], {"id": F.col("id"), "m": F.col("m")})
    assert got(checks, "check", "violations") == {"id: a, b": 1, "id: a, c": 0, "id: b, c": 0, "m: a, b": 1, "m: a, c": 0, "m: b, c": 0}
    with pytest.raises(ChecksFailed, match="id: a, b: 1; m: a, b: 1"):
        require(checks)
    a, b = pools.where("split = 'a'"), pools.where("split = 'b'")
    require(validators.subset("s", a, pools, "id"))
    assert validators.subset("s", a, b, "id").first()["violations"] == 1 and validators.apart("s", a, b, "id").first()["violations"] == 1


def test_contexts_and_future_replies(spark):
    messages = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 5)], "id long, parent long")
    rows = [("a", 3, [1, 2], [4]), ("b", 3, [2], [3]), ("c", 4, [], [1]), ("d", 1, None, [1]), ("e", 8, [], []), ("f", 3, [2, 1, 1], [2])]
    pool = spark.createDataFrame(rows, "example_id string, customer long, context array<long>, replies array<long>")
    assert {r[0] for r in validators.contexts_not_ancestors(pool, messages).collect()} == {"b"}
    assert validators.future_replies(pool).first()["violations"] == 3


def test_membership_and_queues(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 2), ("d", 5)], "k string, g int")
    right = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, g int")
    assert got(validators.one_to_one(left, right, "k", "g"), "check", "violations") == {"left_keys_unique": 1, "right_keys_unique": 0, "every_key_has_a_partner": 1, "attributes_agree": 1}
    queue = spark.createDataFrame([("q", 1, "a", "t", "p", 1), ("q", 3, "b", "u", "p2", 1), ("r", 1, "x", "t", "p", 1)], "queue_name string, queue_position long, example_id string, thread_id string, candidate_pool_sha256 string, seed long")
    pool = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "w")], "example_id string, thread_id string")
    bad = {(r.queue_name, r.check) for r in validators.queues(queue, pool, "thread_id").where("violations > 0").collect()}
    assert bad == {("q", "positions_contiguous"), ("q", "one_pool"), ("q", "thread_id_agrees"), ("r", "examples_known")}
    assert validators.frozen({"status": "frozen", "a": "1"}, {"a": "1"}) == [] and len(validators.frozen({"a": "1"}, {"a": "2"})) == 2
    labels = spark.createDataFrame([("a", "ann"), ("a", "Bot")], "example_id string, annotator string")
    assert got(validators.protected(labels, ["bot"], 3), "check", "violations") == {"expected_size": 1, "ids_unique": 1, "no_machine_labels": 1}


LOG = "run string, example_id string, attempt int, status string, line long, input string, intent string"


def test_label_log(spark):
    rows = [("r", "a", 1, "failure", 1, "i", None), ("r", "a", 2, "success", 2, "i", "x"), ("r", "b", 1, "success", 3, "i", "y"), ("s", "b", 1, "success", 4, "i", "z"), ("s", "c", 1, "failure", 5, "i", None), ("s", "e", 1, "success", 6, "old", "x")]
    log = spark.createDataFrame(rows, LOG)
    queue = spark.createDataFrame([(1, "c"), (2, "a"), (3, "b"), (4, "d"), (5, "e")], "position int, example_id string")
    human, none = queue.where("example_id = 'e'"), queue.limit(0).withColumn("run", F.lit("")).withColumn("reason", F.lit(""))
    chosen = label_log.selected(queue, human, log, ["r", "s"], none)
    assert [(r.example_id, r.run, r.attempt) for r in chosen.collect()] == [("a", "r", 2), ("b", "r", 1)]
    held = spark.createDataFrame([("r", "b", "doubt")], "run string, example_id string, reason string")
    assert got(label_log.selected(queue, human, log, ["r", "s"], held), "example_id", "run") == {"a": "r", "b": "s"}
    assert [r.example_id for r in label_log.pending(queue, human, chosen, log).collect()] == ["c", "d"]
    assert [r.example_id for r in label_log.pending(queue, human, chosen, log, queue.where("position < 4"), True).collect()] == []
    with pytest.raises(ValueError):
        label_log.selected(queue, human, log, ["r", "r"], none)
    r = label_log.report(queue, human, log.where("run = 's'")).first()
    assert (r.expected, r.successes, r.failures, r.not_attempted, r.superseded, r.complete) == (4, 1, 1, 2, 1, False)
    assert {(r.example_id, r.reason) for r in label_log.history(log, {"s": "old"}, held).collect()} == {("b", "old"), ("c", "old"), ("e", "old"), ("b", "doubt")}
    assert got(label_log.log_checks(log.where("run = 'r'"), queue, "r"), "check", "violations") == {"one_run": 0, "examples_of_the_queue": 0, "attempts_contiguous": 0, "nothing_after_success": 0}
    broken = spark.createDataFrame([("r", "a", 2, "success", 1, "", ""), ("r", "a", 1, "failure", 2, "", ""), ("t", "zz", 3, "failure", 3, "", "")], LOG)
    assert got(label_log.log_checks(broken, queue, "r"), "check", "violations") == {"one_run": 1, "examples_of_the_queue": 1, "attempts_contiguous": 2, "nothing_after_success": 1}
    inputs = spark.createDataFrame([("a", "i"), ("b", "i"), ("e", "new")], "example_id string, input string")
    assert got(evaluation.usable_labels(log, inputs, ["x", "y"]), "example_id", "intent") == {"a": "x", "b": "y"}
    assert {r.intent for r in evaluation.attempts_of(chosen, log).collect()} == {"x", "y"}
    tries = spark.createDataFrame([("a", 1, "invalid_output"), ("a", 2, "pause"), ("a", 3, "success"), ("b", 4, "pause")], "example_id string, line long, outcome string")
    assert [(r.attempt, r.status, r.error_code) for r in label_log.as_events(tries, "r").orderBy("line").collect()] == [(1, "failure", "invalid_output"), (2, "success", None)]
    assert label_log.run_identity(model="a", seed=1) != label_log.run_identity(model="b", seed=1)
    assert label_log.fingerprint(["guide"], {"guide": "x"}) != label_log.fingerprint(["guide"], {"guide": "y"})


class Echo:
    def predict(self, messages, contexts):
        return [{"intent": m[:1], "decision": evaluation.HANDLE, "reason_codes": c, "fallback": False} for m, c in zip(messages, contexts, strict=True)]


def test_evaluation(spark):
    inputs = spark.createDataFrame([("1", "abc", ["c"]), ("2", None, None), ("3", "x", [])], "example_id string, message string, context array<string>")
    made = evaluation.predicted(inputs, Echo)
    assert {r.example_id: (r.intent, r.reason_codes) for r in made.collect()} == {"1": ("a", ["c"]), "2": ("", []), "3": ("x", [])}
    labels = spark.createDataFrame([("1", "judgment_saved", "a", "yes"), ("2", "complete", "b", "no"), ("3", "judgment_saved", "y", "no")], "example_id string, status string, intent string, escalate string")
    truth = evaluation.with_truth(inputs.select("example_id", "message", "context"), labels, required=True)
    assert {r.example_id for r in truth.collect()} == {"1", "3"}
    with pytest.raises(ChecksFailed):
        evaluation.with_truth(inputs, labels.limit(0), required=True)
    saved = made.where("example_id = '1'").withColumn("error", F.lit("provider_unavailable")).unionByName(made.where("example_id = '3'"))
    with pytest.raises(ChecksFailed):
        evaluation.scored(truth, saved)
    rows = evaluation.scored(truth, saved, Echo)
    assert {(r.example_id, r.error) for r in evaluation.errors(rows).collect()} == {("3", "intent"), ("1", "unsafe_auto_handle")}
    d = evaluation.diagnostics(rows).first()
    assert (d.total, d.predicted_intents, d.escalation_rate) == (2, 2, 0.0)
    texts = inputs.select("example_id", F.col("message").alias("text"))
    assert [(r.truth, r.intent, r.text) for r in evaluation.diagnosed(rows, texts).collect()] == [("y", "x", "x")]
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    made_up = one(evaluation.combined(F.lit("z_route"), F.lit("an_error"), F.array().cast("array<string>"), F.lit(False), False))
    assert made_up.decision == evaluation.ESCALATE and made_up.reason_codes == ["an_error", evaluation.NO_EVIDENCE, evaluation.NO_CLASSIFIER, "z_route"]
    assert one(evaluation.combined(F.lit(None).cast("string"), F.lit(None).cast("string"), F.array(F.lit("e")), F.lit(False), True)).decision == evaluation.HANDLE
    known = F.array(F.lit("e"), F.lit("f"))
    for draft, own, want in (("ok", ["e"], True), (" ", ["e"], False), ("ok", ["e", "e"], False), ("ok", ["g"], False)):
        assert one(evaluation.valid_draft(F.lit(draft), F.array(*[F.lit(x) for x in own]), known)) is want
    assert evaluation.trivial("a")["decision"] == evaluation.ESCALATE


def test_classifier(spark):
    rows = [(i, "refund the charge please" if i % 2 else "the song stops playing", "billing" if i % 2 else "playback") for i in range(40)] + [(90, None, "billing"), (91, "x", None)]
    df = spark.createDataFrame(rows, "id int, text string, intent string")
    model = IntentModel(max_features=50).fit(df)
    assert model.majority == "billing" and model.blocker is None
    asked = spark.createDataFrame([(1, "a refund of my charge"), (2, "my song is playing"), (3, "zzz"), (4, None)], "id int, text string")
    said = got(model.predict(asked), "id", "intent")
    assert said[1] == "billing" and said[2] == "playback" and set(said) == {1, 2, 3, 4}
    assert set(got(model.predict(asked, trivial=True), "id", "intent").values()) == {"billing"}
    lone = IntentModel().fit(df.where("intent = 'billing'"))
    assert "two classes" in lone.blocker
    with pytest.raises(Blocked):
        lone.predict(asked)
    assert IntentModel().fit(df.withColumn("text", F.lit("!"))).blocker == "empty vocabulary"
    assert "convergence" in IntentModel(rounds=1).fit(df).blocker


def test_vectors_cache_and_encoder(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ab"), (2, "b")], "id int, text string")
    build = lambda: evaluation.encoded(texts, lambda ts: [[len(t), 1.0] for t in ts])
    folder = f"file://{tmp_path}/c"
    first, hit = cache.cached_vectors(spark, folder, {"texts": "d"}, build)
    again, hit2 = cache.cached_vectors(spark, folder, {"texts": "d"}, lambda: pytest.fail("built twice"))
    assert (hit, hit2) == (False, True) and files.content_digest(first) == files.content_digest(again)
    assert cache.cached_vectors(spark, folder, {"texts": "e"}, build)[1] is False
    with pytest.raises(Exception, match="length one"):
        cache.cached_vectors(spark, folder, {"texts": "f"}, lambda: spark.createDataFrame([(1, [3.0])], "id int, vector array<float>"))
    with pytest.raises(Exception, match="zero"):
        evaluation.encoded(texts, lambda ts: [[0.0] for _ in ts]).count()


def test_settings(tmp_path):
    good = {"support_author": "us", "split": {"train": 0.5, "development": 0.25, "test": 0.25}, "safe_domains": ["a.example"], "rate": {"max_backoff_seconds": 30}}
    s = settings.checked(good)
    assert s.split.train == 0.5 and s.safe_domains == ("a.example",) and s.rate.max_backoff_seconds == 30.0 and s.seed == 42
    for bad in ({}, {"support_author": "us", "more": 1}, {"support_author": 3}, {**good, "split": {"train": 0.9}}, {**good, "near": {"threshold": 2}}, {**good, "rate": {"initial_backoff_seconds": 99}}, {**good, "seed": True}, [1]):
        with pytest.raises(settings.SettingsError):
            settings.checked(bad)
    p = tmp_path / "s.json"
    p.write_text('{"support_author": "us"}')
    assert settings.read_settings(str(p)).samples.training == 300


def test_lock_sections_codec(spark, tmp_path):
    path = f"file://{tmp_path}/run.lock"
    with files.run_lock(spark, path):
        with pytest.raises(RuntimeError):
            with files.run_lock(spark, path):
                pass
    with files.run_lock(spark, path):
        pass
    assert files.sections("# g\n## A\nx\n## B\ny\n## C\nz\n", ["C", "A"]) == "## C\nz\n\n## A\nx"
    with pytest.raises(ValueError):
        files.sections("## A\nx", ["B"])
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("flags", T.ArrayType(T.StringType())), T.StructField("seen", T.BooleanType()), T.StructField("n", T.IntegerType())])
    rows = [("a", ["x", "y,z"], True, 3), ("b", [], False, None), (None, ["é"], False, 1)]
    df = spark.createDataFrame(rows, schema)
    flat = files.flat_record(df, ["flags"], ["seen"])
    assert flat.columns == ["id", "flags_json", "seen", "n"] and dict(flat.dtypes)["n"] == "string"
    assert sorted(map(tuple, files.nested_record(flat, schema, ["flags"], ["seen"]).collect()), key=str) == sorted(rows, key=str)
    (tmp_path / "f").write_bytes(b"abc")
    import hashlib

    assert files.file_digest(spark, f"file://{tmp_path}/f") == hashlib.sha256(b"abc").hexdigest() == files.file_digests(spark, f"file://{tmp_path}/f").first()["digest"]
    with pytest.raises(ValueError):
        files.write_fixed(df, f"file://{tmp_path}/w", ["id", "more"])
    assert spark.createDataFrame([('["a"]',), ("",), (None,)], "j string").select(files.json_list(F.col("j"))).collect()[0][0] == ["a"]


def test_author_and_shortfall(spark):
    rows = spark.createDataFrame([("Brand",), ("x",)], "author string")
    extraction.require_author(rows, "Brand")
    with pytest.raises(ValueError, match="other spellings: Brand"):
        extraction.require_author(rows, "BRAND")
    pool = spark.createDataFrame([(f"e{i}", f"g{i % 5}", "refund my card" if i % 2 else "hi", []) for i in range(10)], "example_id string, group_id string, text string, context array<string>")
    assert sampling.uniform(pool, 5, 1, "n", strict=True).count() == 5
    for f in (lambda: sampling.uniform(pool, 6, 1, "n", strict=True), lambda: sampling.stratified(pool, 6, 1, strict=True), lambda: sampling.challenge(pool, 4, 4, 1, strict=True)):
        with pytest.raises(sampling.Shortfall):
            f()
    first = sampling.uniform(pool, 1, 1, "n")
    more = sampling.extend(first, pool, 2, 1, "m", buckets=["billing"])
    assert more.count() == 3
