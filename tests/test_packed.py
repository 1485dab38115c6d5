"""Splitting packed fields."""

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from threadloom.operators.packed import resolve, split_packed

CASES = {
    "1001,1002": ["1001", "1002"], '"1001,1002"': ["1001", "1002"], '"1001";"1002"': ["1001", "1002"], "['1001', '1002']": ["1001", "1002"], "{1001,1002}": ["1001", "1002"], "1001 / 1002": ["1001", "1002"], "1001 and 1002": ["1001", "1002"],
    "1001\n1002": ["1001", "1002"], "1001，1002": ["1001", "1002"], "1001&1002": ["1001", "1002"], "1001|nan|1002": ["1001", "1002"], "1001,,1002,": ["1001", "1002"], "1001.0, 1002": ["1001", "1002"], "0001001;1001": ["1001", "1001"],
    '"1,000,185,781","1,001,166,724"': ["1000185781", "1001166724"], '"1,000,185,781"|1001379748': ["1000185781", "1001379748"], '"1,000,185,781;1,001,166,724"': ["1000185781", "1001166724"], "12,345": ["12", "345"], '"12,345"': ["12345"],
    "": [], None: [], "nan": [], "[]": [], '""': [], "1001": ["1001"], "1001.0": ["1001"], ",1001": ["1001"], "a1001b,1002": ["1002"], "1.5,1002": ["1002"],
}


def test_cases(spark):
    rows = [(i, v) for i, v in enumerate(CASES)]
    df = spark.createDataFrame(rows, "source_record long, f string")
    got = {}
    for x in split_packed(df, ["f"], ["source_record"]).orderBy("source_record", "pos").collect():
        got.setdefault(x.source_record, []).append((x.pos, x.id_value))
    for i, v in rows:
        assert [p for _, p in got.get(i, [])] == CASES[v], v
        assert [p for p, _ in got.get(i, [])] == list(range(1, len(CASES[v]) + 1)), v
    two = split_packed(df, ["f"], ["source_record"], least=2)
    assert {x.source_record for x in two.collect()} == {i for i, v in rows if len(CASES[v]) > 1}


def test_odd_tables(spark):
    long = ";".join(str(i + 1000) for i in range(20000))
    df = spark.createDataFrame([(1, long, "x", None), (1, long, "x", None), (None, "7,8", "y", 3)], "k long, f string, pos_ string, _f long").withColumnRenamed("pos_", "_shape")
    got = split_packed(df, ["f"], ["k"])
    assert got.where("k = 1").count() == 40000 and got.where("k is null").count() == 2
    assert split_packed(df.limit(0), ["f"], ["k"]).count() == 0
    assert split_packed(df.selectExpr("k", "cast(null as string) f"), ["f"], ["k"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1000, 10**12), min_size=1, max_size=6), st.sampled_from([",", ";", " | ", " ", "\t", "&", " and ", " / "]))
def test_rules_give_back_what_was_joined(values, delimiter):
    import re

    field = delimiter.join(map(str, values))
    shape = re.sub("[0-9]{4,}", "N", re.sub(r"[^\W\d_]+", "w", field))
    assert resolve(shape) == [[i + 1] for i in range(len(values))]
