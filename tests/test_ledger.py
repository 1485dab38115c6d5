"""Waits and refusals against worked examples."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import transport
from threadloom.operators.ledger import Budget, waits

HEADERS = "struct<limit_requests: long, remaining_requests: long, reset_requests_seconds: double, limit_tokens: long, remaining_tokens: long, reset_tokens_seconds: double>"
LEDGER = f"model string, kind string, time double, input_tokens long, output_tokens long, limit_category string, headers {HEADERS}"


def made(t, a, b=0, model="m"):
    return (model, "reservation", float(t), a, b, None, None)


def said(t, category=None, headers=None):
    return ("m", "response", float(t), None, None, category, headers)


def asked(spark, rows, ledger, budget):
    df = spark.createDataFrame([(i, "m", float(t), a, b) for i, (t, a, b) in enumerate(rows)], "request int, model string, now double, input_tokens long, output_tokens long")
    return {x.request: (x.wait, x.pause) for x in waits(df, spark.createDataFrame(ledger, LEDGER), budget).collect()}


def test_waits(spark):
    small = Budget(requests_per_minute=2, tokens_per_minute=100)
    got = asked(spark, [(110, 20, 20), (161, 20, 20), (110, 101, 0)], [made(100, 80)], small)
    assert got[0][0] == pytest.approx(50.1) and got[1] == (0.0, None) and got[2][0] is None and "single request" in got[2][1]
    late = (None, 0, 10000.0, 100, None, None)
    assert asked(spark, [(110, 20, 20)], [made(100, 10), said(100, None, late)], small)[0][0] > 9000
    assert "daily" in asked(spark, [(110, 1, 1)], [said(100, "daily")], small)[0][1]
    assert "no reset" in asked(spark, [(110, 1, 1)], [said(100, None, (None, 0, None, None, None, None))], small)[0][1]
    wide = Budget(requests_per_minute=60, tokens_per_minute=100)
    two = [made(100, 40), made(110, 40), said(101), said(111), made(100, 99, model="other")]
    got = asked(spark, [(120, 25, 10), (171, 25, 10)], two, wide)
    assert got[0][0] == pytest.approx(40.1) and got[1] == (0.0, None)
    daily = Budget(requests_per_minute=60, tokens_per_minute=100, requests_per_day=2)
    got = asked(spark, [(171, 25, 10), (86511, 25, 10)], two, daily)
    assert "daily" in got[0][1] and got[1] == (0.0, None)
    assert asked(spark, [(5, 1, 1)], two[:0] or [made(900, 1)], wide)[0] == (0.0, None)


def test_waits_equal_dropping_the_oldest_one_by_one(spark):
    import random

    r = random.Random(3)
    ledger = [made(r.choice([t, t + 0.5]), r.randint(0, 30), r.randint(0, 30)) for t in range(0, 300, 3) for _ in range(r.choice([0, 1, 3]))]
    budget = Budget(requests_per_minute=20, tokens_per_minute=400, output_tokens_per_minute=200)
    rows = [(t + 0.25, r.randint(0, 60), r.randint(0, 60)) for t in range(1, 400, 7)]
    got = asked(spark, rows, ledger, budget)
    for i, (now, a, b) in enumerate(rows):
        minute = sorted((x for x in ledger if now - 60 < x[2] <= now), key=lambda x: x[2])
        want = 0.0
        for cost, cap, f in ((1, 20, lambda x: 1), (a + b, 400, lambda x: x[3] + x[4]), (b, 200, lambda x: x[4])):
            used = sum(f(x) for x in minute)
            for x in minute:
                if used + cost <= cap:
                    break
                used -= f(x)
                want = max(want, x[2] + 60.1 - now)
        every = [x[2] for x in ledger if now - 86400 < x[2] <= now]
        if every:
            want = max(want, max(every) + 3.1 - now)
        assert got[i][0] == pytest.approx(want, abs=1e-5), (i, rows[i])


def test_waits_in_a_crowded_ledger_join_no_pairs(spark):
    """Thousands of reservations within one minute and negative ones: right, without a join by time; only negative tokens are joined by the minute."""
    import random
    from unittest import mock

    from threadloom.operators import ledger as module

    r = random.Random(4)
    book = [made(100 + r.random() * 50, r.randint(0, 3), r.randint(0, 3)) for _ in range(3000)]
    budget = Budget(requests_per_minute=2500, tokens_per_minute=8000, output_tokens_per_minute=3000)
    rows = [(90 + 3 * i, r.randint(0, 50), r.randint(0, 50)) for i in range(60)] + [(None, 1, 1), (100, 1, 1), (100, 1, 1)]
    df = spark.createDataFrame([(i, "m", None if t is None else float(t), a, b) for i, (t, a, b) in enumerate(rows)], "request int, model string, now double, input_tokens long, output_tokens long")

    def check(book, forbidden):
        with mock.patch.object(module, "_within", side_effect=AssertionError if forbidden else module._within):
            got = {x.request: x.wait for x in waits(df, spark.createDataFrame(book, LEDGER), budget).collect()}
        assert len(got) == len(rows)
        for i, (now, a, b) in enumerate(rows):
            minute = sorted((x for x in book if now is not None and now - 60 < x[2] <= now), key=lambda x: x[2])
            want = 0.0
            for cost, cap, f in ((1, 2500, lambda x: 1), (a + b, 8000, lambda x: x[3] + x[4]), (b, 3000, lambda x: x[4])):
                later = 0
                for x in reversed(minute):
                    later += f(x)
                    if later + cost > cap:
                        want = max(want, x[2] + 60.1 - now)
                        break
            day = [x[2] for x in book if now is not None and now - 86400 < x[2] <= now]
            want = max([want] + [t + 60 / 2500 + 0.1 - now for t in day])
            assert got[i] == pytest.approx(want, abs=1e-5), (i, rows[i])

    check(book, True)
    check(book + [made(100 + r.random() * 50, -r.randint(0, 9), 2) for _ in range(300)], False)


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    values = ["2m59.56s", "12.5s", "1d2h", "300ms", "NaN", "", None, "5 s"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(transport.seconds(F.col("v")))
    assert [None if r[0] is None else round(r[0], 3) for r in df.collect()] == [179.56, 12.5, 93600.0, 0.3, None, None, None, None]
    u = one(transport.usage(F.lit('{"usage": {"prompt_tokens": 5, "total_tokens": "7x", "other": 1, "prompt_tokens_details": {"cached_tokens": 2}}}')))
    assert (u.prompt_tokens, u.completion_tokens, u.total_tokens, u.cached_tokens) == (5, None, None, 2)
    assert one(transport.reservation(F.lit(100))) == 623 and one(transport.reservation(F.lit(101))) == 624
    h = one(transport.quota_headers(F.create_map(F.lit("x-ratelimit-limit-tokens"), F.lit("100"), F.lit("x-ratelimit-reset-tokens"), F.lit("1m1s"))))
    assert h.limit_tokens == 100 and h.reset_tokens_seconds == 61.0 and h.remaining_requests is None
    assert one(transport.safe_identifier(F.lit("Requests_per.day/x"))) and one(transport.safe_identifier(F.lit("my-password"))) is None
    cases = [
        (429, [], ["RequestsPerMinute"], False, False, "temporary"), (429, [], ["RequestsPerDay"], False, True, "daily"), (429, [], ["Requests"], False, False, "unknown"), (429, ["BILLING_DISABLED"], ["x per day"], False, False, "billing"),
        (429, [], ["Tokens"], True, False, "quota_unavailable"), (429, ["QUOTA_EXCEEDED"], [], False, True, "unknown"), (429, [], [], False, True, "temporary"), (503, [], [], False, False, "temporary"), (500, None, None, None, None, "not_rate_limited"),
    ]
    df = spark.createDataFrame(cases, "s int, r array<string>, q array<string>, z boolean, d boolean, want string")
    assert [x for x in df.select(transport.refusal(*[F.col(c) for c in "srqzd"]).alias("got"), "want").collect() if x.got != x.want] == []
    waits_ = [one(transport.retry_wait(F.lit(i), F.lit(1.0), F.lit(u), F.lit(100.0), 5, 30)) for i, u in ((0, 160.0), (0, 90.0), (1, None), (9, 0.0))]
    assert waits_ == [60.0, 6.0, 11.0, 30.0]
