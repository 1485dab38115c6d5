"""Readers and writers."""

import json

import os

import pytest
from pyspark.sql import functions as F

from threadloom.sources import files


def test_messages_csv(spark, tmp_path):
    head = ",".join(files.MESSAGE_COLUMNS)
    (tmp_path / "a.csv").write_text(f'{head},extra\n1,Brand,False,t,"line one\nline ""two""",,NA,x\n2,c,True,t,,3,1,y\n', encoding="utf-8")
    got = files.read_messages_csv(spark, str(tmp_path / "a.csv")).orderBy("source_record").collect()
    assert [(r.source_record, r.tweet_id, r.text, r.response_tweet_id, r.in_response_to_tweet_id) for r in got] == [(2, "1", 'line one\nline "two"', "", "NA"), (3, "2", "", "3", "1")]
    (tmp_path / "b.csv").write_text("tweet_id\n1\n", encoding="utf-8")
    with pytest.raises(ValueError, match="author_id, created_at, in_response_to_tweet_id, inbound, response_tweet_id, text"):
        files.read_messages_csv(spark, str(tmp_path / "b.csv"))


def test_csv_round_trip(spark, folder, tmp_path):
    rows = spark.read.parquet(f"{folder}/records.parquet").orderBy("source_record").select(*[F.coalesce(c, F.lit("")).alias(c) for c in files.MESSAGE_COLUMNS])
    rows = rows.where(~F.col("text").contains("\r")).coalesce(1)
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(str(tmp_path / "c"))
    back = files.read_messages_csv(spark, str(tmp_path / "c")).drop("source_record")
    assert rows.exceptAll(back).count() == 0 and back.exceptAll(rows).count() == 0


def test_strict_json(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.read_strict_json(spark, str(tmp_path / "good.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="(?s)."):
        files.read_strict_json(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_last_json(spark, tmp_path):
    lines = [{"id": "x", "n": 1}, {"id": "x", "n": 2}, {"id": "y", "n": 3, "error": "provider_unavailable"}]
    (tmp_path / "cache.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    field = lambda p: F.get_json_object("line", p)
    got = files.read_last_json(spark, str(tmp_path / "cache.jsonl"), field("$.id"), field("$.n").cast("int"), field("$.error") == "provider_unavailable").collect()
    assert [(r.key, json.loads(r.line)["n"]) for r in got] == [("x", 2)]


def test_in_list_is_pushed_down(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) k", "id v", "id w").write.parquet(str(tmp_path / "t"))
    df = files.read_where_in(spark, str(tmp_path / "t"), "k", ["1", "2"], ["v"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 2 and "In(k, [1,2])" in plan and "w#" not in plan
    with pytest.raises(ValueError):
        files.read_where_in(spark, str(tmp_path / "t"), "k", ["1", "99"], ["v"])


def test_labels_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("example_id,note\na, \nb,x\n")
    assert {(r.example_id, r.note) for r in files.read_labels_csv(spark, str(tmp_path / "l.csv"), ["note"]).collect()} == {("a", None), ("b", "x")}
    (tmp_path / "m.csv").write_text("example_id,note\na,1\na,2\n")
    with pytest.raises(ValueError):
        files.read_labels_csv(spark, str(tmp_path / "m.csv"), ["note"])


def test_replacing_appending_addressing(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    files.write_replacing(spark.range(3), folder)
    files.write_replacing(spark.range(5), folder)
    assert files.read_current(spark, folder).count() == 5
    log = f"file://{tmp_path}/log"
    for _ in range(2):
        files.append_events(spark.createDataFrame([(1, None)], "a int, b string"), log)
    assert files.read_strict_json(spark, log, "a int, b string").count() == 2
    path = files.write_addressed(spark, str(tmp_path / "d"), {"b": 1, "a": "é"})
    assert path == files.write_addressed(spark, str(tmp_path / "d"), {"a": "é", "b": 1})
    open(path, "w").write("other")
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    with pytest.raises(ValueError):
        files.write_addressed(spark, str(tmp_path / "d"), {"a": "é", "b": 1})


def test_content_digest(spark):
    df = spark.range(100).selectExpr("id", "cast(null as string) x")
    assert files.content_digest(df) == files.content_digest(df.repartition(7).select("x", "id"))
    assert files.content_digest(df) != files.content_digest(df.where("id < 99"))
