"""Predictions against labels: joins of inputs, labels, predictions and references, decisions, diagnostics, and systems as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.validators import ChecksFailed

# Decisions and reasons of the structural report.
ESCALATE, HANDLE = "proposed_escalate", "proposed_auto_handle"
NO_EVIDENCE, NO_CLASSIFIER = "insufficient_retrieval_or_generation_evidence", "intent_classifier_unavailable"

#: What a system says about one example.
PREDICTION = T.StructType([
    T.StructField("intent", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("reason_codes", T.ArrayType(T.StringType())),
    T.StructField("fallback", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("draft", T.StringType()), T.StructField("evidence_ids", T.ArrayType(T.StringType())),
])


class System(Protocol):
    """A system under evaluation. ``predict`` gets whole batches and gives one dict of :data:`PREDICTION` fields per example; absent ones are null."""

    def predict(self, messages: list[str], contexts: list[list[str]]) -> list[dict[str, object]]: ...


def predicted(inputs: DataFrame, make: Callable[[], System]) -> DataFrame:
    """``example_id`` and the prediction for ``example_id, message, context``; ``make`` builds the system once in each worker process."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = make()
        for batch in batches:
            said = system.predict(batch["message"].fillna("").tolist(), [[] if c is None else list(c) for c in batch["context"]])
            frame = pd.DataFrame([{f: s.get(f) for f in PREDICTION.names} for s in said], columns=PREDICTION.names).astype(object)
            frame.insert(0, "example_id", batch["example_id"].tolist())
            yield frame.where(frame.notna(), None)

    schema = T.StructType([inputs.schema["example_id"], *PREDICTION.fields])
    return inputs.select("example_id", "message", "context").mapInPandas(scan, schema)


def encoded(texts: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 256) -> DataFrame:
    """``id, vector`` of unit length for ``id, text`` by an encoder of lists of texts. A vector that is zero or not finite ends the job."""
    import numpy as np

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            values = rows["text"].fillna("").tolist()
            for i in range(0, len(values), batch):
                made = np.asarray(encode(values[i : i + batch]), dtype=np.float32)
                size = np.linalg.norm(made, axis=1, keepdims=True)
                if made.ndim != 2 or not np.isfinite(made).all() or (size == 0).any():
                    raise ValueError("an encoder gave a vector that is zero or not finite")
                yield pd.DataFrame({"id": rows["id"].iloc[i : i + batch].to_numpy(), "vector": list(made / size)})

    return texts.select("id", "text").mapInPandas(scan, f"id {dict(texts.dtypes)['id']}, vector array<float>")


def with_truth(inputs: DataFrame, labels: DataFrame, statuses: Sequence[str] = ("judgment_saved",), required: bool = False) -> DataFrame:
    """``inputs`` with ``truth`` and ``should`` (escalate) from labels ``example_id, status, intent, escalate``.

    Only labels of the given statuses count. With ``required`` inputs without a label go, and no label at all is an error.
    """
    usable = labels.where(F.col("status").isin(list(statuses))).select("example_id", F.col("intent").alias("truth"), (F.col("escalate") == "yes").alias("should"))
    if required and usable.isEmpty():
        raise ChecksFailed("no completed labels")
    return inputs.join(usable, "example_id", "inner" if required else "left")


def usable_labels(log: DataFrame, inputs: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """``example_id, intent`` of successful tries with an allowed intent that were made from the input as it is now (``input`` digests agree)."""
    now = inputs.select("example_id", F.col("input").alias("_now"))
    good = log.where((F.col("status") == "success") & F.col("intent").isin(list(allowed))).join(now, "example_id")
    return good.where("input = _now").select("example_id", "intent")


def attempts_of(chosen: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of the log that a selection ``example_id, run, attempt`` names."""
    return log.join(chosen.select("example_id", "run", "attempt"), ["example_id", "run", "attempt"])


def scored(inputs: DataFrame, predictions: DataFrame, live: Callable[[], System] | None = None) -> DataFrame:
    """``inputs`` (with truth) joined to cached predictions by example; misses are predicted by ``live``, or an error without it."""
    last = predictions.where(F.coalesce(F.col("error"), F.lit("")) != "provider_unavailable")
    hits = inputs.join(last, "example_id")
    missing = inputs.join(last.select("example_id"), "example_id", "left_anti")
    if live is None:
        n = missing.count()
        if n:
            raise ChecksFailed(f"{n} examples have no cached prediction")
        return hits
    made = predicted(missing, live)
    return hits.unionByName(missing.join(made, "example_id"))


def decision(*reasons: Column) -> Column:
    """``decision, reason_codes``: any reason that is not null escalates; codes are distinct and sorted."""
    codes = F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
    return F.struct(F.when(F.size(codes) > 0, ESCALATE).otherwise(HANDLE).alias("decision"), codes.alias("reason_codes"))


def combined(route: Column, error: Column, evidence: Column, insufficient: Column, classifier: bool) -> Column:
    """:func:`decision` of a system: the reason of its route, an error of generation, missing evidence, a missing classifier."""
    bare = (F.size(F.coalesce(evidence, F.array().cast("array<string>"))) == 0) | F.coalesce(insufficient, F.lit(False))
    return decision(route, error, F.when(bare, NO_EVIDENCE), F.lit(None if classifier else NO_CLASSIFIER).cast("string"))


def valid_draft(draft: Column, evidence: Column, retrieved: Column, unsafe: Column | None = None) -> Column:
    """Whether a draft is not blank, cites distinct evidence, only what was retrieved, and makes no unsafe claim."""
    own = F.coalesce(evidence, F.array().cast("array<string>"))
    known = F.coalesce(retrieved, F.array().cast("array<string>"))
    fine = (F.trim(F.coalesce(draft, F.lit(""))) != "") & (F.size(F.array_distinct(own)) == F.size(own)) & (F.size(F.array_except(own, known)) == 0)
    return fine if unsafe is None else fine & ~F.coalesce(unsafe, F.lit(False))


def diagnostics(rows: DataFrame) -> DataFrame:
    """One row ``total, predicted_intents, escalation_rate, fallback_rate, empty_retrieval_rate`` over predictions; rates are 0 without rows."""
    rate = lambda c, n: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0)), 6).alias(n)
    return rows.agg(
        F.count("*").alias("total"), F.count_distinct(F.nullif("intent", F.lit(""))).alias("predicted_intents"), rate(F.col("decision") == ESCALATE, "escalation_rate"),
        rate(F.col("fallback"), "fallback_rate"), rate(F.array_contains("reason_codes", NO_EVIDENCE), "empty_retrieval_rate"),
    )


def errors(rows: DataFrame) -> DataFrame:
    """``example_id, error``: wrong or missing intents of labelled rows, and cases to escalate that were handled."""
    intent = rows.where(F.col("truth").isNotNull() & ~F.col("truth").eqNullSafe(F.col("intent"))).select("example_id", F.lit("intent").alias("error"))
    unsafe = rows.where(F.col("should") & (F.col("decision") == HANDLE)).select("example_id", F.lit("unsafe_auto_handle").alias("error"))
    return intent.unionByName(unsafe)


def diagnosed(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``example_id, truth, intent, text``: mismatches that are no fallbacks, with the text of each."""
    wrong = rows.where(~F.coalesce(F.col("fallback"), F.lit(False)) & F.col("truth").isNotNull() & ~F.col("truth").eqNullSafe(F.col("intent")))
    return wrong.select("example_id", "truth", "intent").join(texts.select("example_id", "text"), "example_id", "left")


def class_summary(labels: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """``label, n, missing``: labels per allowed class, those without any too, and labels outside of it."""
    wanted = labels.sparkSession.createDataFrame([(a, True) for a in sorted(set(allowed))], "label string, _allowed boolean")
    have = labels.where("intent is not null").groupBy(F.col("intent").alias("label")).agg(F.count("*").alias("n"))
    return have.join(wanted, "label", "full").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"), F.col("_allowed").isNull().alias("unknown"))


def trivial(majority: str | None) -> Mapping[str, object]:
    """What the trivial system says of everything: the majority class, escalated."""
    return {"intent": majority, "decision": ESCALATE, "reason_codes": [], "fallback": False}
