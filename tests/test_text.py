"""Text repair, redaction and shingles."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import hashing, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_normalized(spark):
    assert one(spark, "  I can't use it on iPhone 15 — Error 42! 😭 ", text.normalized) == "I can't use it on iPhone 15 — Error 42! 😭"
    assert one(spark, "donâ€™t  wait​﻿", text.normalized) == "don’t wait"
    assert one(spark, "Café", text.normalized) == "Café"
    assert one(spark, None, text.normalized) == ""


def test_duplicate_form(spark):
    assert one(spark, " Straße\t ＡＢ ", text.duplicate_form) == "strasse ab"


def test_redaction_classes(spark):
    given = "@Brand @me_1 mail a.b@c.org from 10.1.2.3, call +1 (212) 555-0100, ref 1234567, see https://help.safe.example/x?y=1. and http://evil.test/a), www.x.org"
    got = spark.createDataFrame([(given,)], "t string").select(text.redacted(F.col("t"), ["brand"], ["safe.example"])).first()[0]
    assert got == "[BRAND] [CUSTOMER] mail [EMAIL] from [IP], call [PHONE], ref [NUMBER], see [URL:help.safe.example]. and [URL]), [URL]"
    steps = text.redaction_steps(F.col("t"), ["brand"], ["safe.example"])
    counts = spark.createDataFrame([(given,)], "t string").select(*[c.alias(n) for n, c, _ in steps]).first().asDict()
    assert counts == {"email": 1, "safe_url": 1, "url": 2, "ip_address": 1, "phone": 1, "brand_handle": 1, "customer_handle": 1, "long_number": 1}


def test_safe_host_in_capitals_and_broken_url(spark):
    f = lambda c: text.redacted(c, [], ["safe.example"])
    assert one(spark, "HTTPS://Help.SAFE.example/a b", f) == "[URL:help.safe.example] b"
    assert one(spark, "http://[x and safe.example.evil.test", f) == "[URL] and safe.example.evil.test"


def test_audit_redaction(spark):
    assert one(spark, "@a https://x.y/z 1234567 " + "w" * 600, text.audit_redacted)[:26] == "[USER] [URL] [NUMBER] wwww"


@settings(max_examples=15, deadline=None)
@given(st.text("abc ", min_size=0, max_size=9))
def test_shingles(spark, value):
    got = one(spark, value, lambda c: text.char_shingles(c, 4))
    assert set(got) == {value[i : i + 4] for i in range(max(1, len(value) - 3))}


def test_stable_ids(spark):
    import hashlib

    got = spark.createDataFrame([(["b", "a"],)], "m array<string>").select(hashing.stable_id("p", F.col("m")), hashing.rank_hash(42, "n", F.lit("e")), hashing.discovery_hash(42, F.lit("e"))).first()
    assert got[0] == "p_" + hashlib.sha256(b"a\0b").hexdigest()[:16]
    assert got[1] == hashlib.sha256(b"42|n|e").hexdigest() and got[2] == hashlib.sha256(b"42:e").hexdigest()
