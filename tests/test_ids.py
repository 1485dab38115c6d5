"""Ids, flags and times in their spellings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.functions import ids


def read(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_message_ids(spark):
    cases = {"12": 12, "0012": 12, " 12\t": 12, '"12"': 12, "'12'": 12, "[12]": 12, '["12"]': 12, "12.0": 12, "12.": 12, "12.00": 12, '"1,200"': 1200, "+7": 7, "​12​": 12}
    cases |= {None: None, "": None, " ": None, "nan": None, "12a": None, "1 2": None, "1.5": None, ".0": None, "12,13": None, "9" * 40: None, "1,20": None}
    assert read(spark, ids.message_id, list(cases)) == list(cases.values())


def test_name_ids(spark):
    assert read(spark, ids.name_id, [" Example_AB ", "x ", "", " \t", None]) == ["example_ab", "x", None, None, None]


def test_flags(spark):
    assert read(spark, ids.flag, ["True", " fALSE\t", "t", "1", "yes", "", None, "n/a"]) == [True, False, None, None, None, None, None, None]


def test_moments(spark):
    at = dt.datetime(2023, 3, 4, 19, 1, 19)
    good = ["Sat Mar 04 19:01:19 +0000 2023", " Sat Mar 04 20:01:19 +0100 2023 ", "2023-03-04T19:01:19Z", "2023-03-04 19:01:19+00:00", "2023-03-04 19:01:19", "2023-03-04 11:01:19-0800"]
    assert read(spark, ids.moment, good) == [at] * len(good)
    bad = ["0000-00-00 00:00:00", "not-a-timestamp", "null", "yesterday", "", None, "2023", "Sat Mar 44 19:01:19 +0000 2023", "2023-02-30 01:00:00"]
    assert read(spark, ids.moment, bad) == [None] * len(bad)
