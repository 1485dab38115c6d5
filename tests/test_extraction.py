"""Threads, relationships and examples on a small graph of edge cases."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import extraction

BRAND = "Brand"


def message(i, author, parent="", responses="", text="hello there", time="Tue Oct 31 22:{:02d}:00 +0000 2017", inbound=None):
    return (str(i), author, inbound if inbound is not None else str(author not in (BRAND, "OtherCare")), time.format(i % 60), text, responses, str(parent))


ROWS = [
    message(1, "c1", responses="2"), message(2, BRAND, 1),
    message(10, "c2", responses="11"), message(11, BRAND, 10, "12"), message(12, "c2", 11, "13"), message(13, BRAND, 12),
    message(20, "c3", responses="21,22"), message(21, BRAND, 20, "23"), message(22, BRAND, 20, "24"), message(23, "c3", 21, "25"), message(24, "c3", 22, "26"), message(25, BRAND, 23), message(26, BRAND, 24),
    message(30, "c4", 999, "31"), message(31, BRAND, 30),
    message(40, "c5", responses="41"), message(41, BRAND, 999), message(42, BRAND, 40), message(43, "c5", 42, "41"),
    message(50, "c6", responses="51"), message(50, "c6", responses="51"), message(51, BRAND, 50),
    message(52, "c7", responses="53"), message(52, "c7", responses="54", text="other"), message(53, BRAND, 52), message(54, BRAND, 52),
    message(60, "c8", responses="61,62"), message(61, BRAND, 60), message(62, "OtherCare", 60),
    message(70, "c9", 71, "72"), message(71, "c9", 70), message(72, BRAND, 70),
    message(80, "c10", time="not-a-timestamp", responses="81"), message(81, BRAND, 80),
    message(90, "c11", text="", responses="91"), message(91, BRAND, 90),
]


@pytest.fixture(scope="module")
def built(spark):
    rows = [(i + 2, *r) for i, r in enumerate(ROWS)]
    raw = spark.createDataFrame(rows, "source_record long, tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string")
    parsed = extraction.parsed(raw).cache()
    messages = extraction.canonical(parsed).cache()
    members = extraction.threads(messages, BRAND).select("id", "thread_id").cache()
    found = {r.customer: r for r in extraction.examples(messages, members, BRAND).collect()}
    status = {(r.parent, r.child): r.status for r in extraction.relationships(messages, members).collect()}
    return parsed, messages, members, found, status


def test_examples(built):
    found = built[3]
    kept = {k for k, r in found.items() if not r.reasons}
    assert kept == {1, 10, 12, 20, 23, 24, 30, 40, 50, 80}
    assert list(found[12].context) == [10, 11] and list(found[12].replies) == [13]
    assert list(found[23].context) == [20, 21] and list(found[20].replies) == [21, 22]
    assert list(found[30].context) == []


def test_exclusions(built):
    found = built[3]
    assert list(found[43].reasons) == ["no_verified_direct_reply"]
    assert list(found[52].reasons) == ["conflicting_duplicates"]
    assert list(found[60].reasons) == ["cross_brand_ambiguous"]
    assert list(found[70].reasons) == ["cyclic_relationships"]
    assert list(found[90].reasons) == ["missing_customer_text"]


def test_relationships(built):
    status = built[4]
    assert status[(1, 2)] == "consistent" and status[(999, 30)] == "missing_parent_target"
    assert status[(40, 42)] == "parent_response_disagrees" and status[(40, 41)] == "conflicting_parent_claim"
    assert status[(999, 41)] == "missing_parent_target" and status[(60, 62)] == "consistent"


def test_duplicates_and_threads(built):
    parsed, messages, members, *_ = built
    got = {r.id: (r.copies, r.variants) for r in messages.where("copies > 1").collect()}
    assert got == {50: (2, 1), 52: (2, 2)}
    assert extraction.duplicates(parsed).count() == 4
    per = {r.thread_id: r.messages for r in extraction.rollup(messages, members, BRAND).collect()}
    assert sorted(per.values(), reverse=True)[:2] == [7, 4]


def test_empty(spark, built):
    parsed = built[0].limit(0)
    messages = extraction.canonical(parsed)
    members = extraction.threads(messages, BRAND).select("id", "thread_id")
    assert extraction.examples(messages, members, BRAND).count() == 0
    assert extraction.relationships(messages, members).count() == 0
