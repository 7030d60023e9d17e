"""Runs that follow one another, envelopes with a rest, key prefixes, repeated keys."""

import pytest

from loglathe import Sinks, run_batch
from loglathe.operators.unwrap import object_lines
from loglathe.plans.jobs import parse_batch
from loglathe.plans.index import HashIndex
from loglathe.sources.files import list_keys

NOW = "2026-06-01T00:00:00+00:00"



def test_runs_add_to_the_sinks(spark, lines, tmp_path):
    sinks = Sinks.under(str(tmp_path / "out"))
    run_batch(lines(["one", "two"]), sinks, ingest_ts=NOW)
    run_batch(lines(["two", "three"]), sinks, ingest_ts=NOW)
    assert spark.read.text(sinks.review).count() + spark.read.text(sinks.confident).count() == 3


def test_index_keeps_its_buckets(spark, lines, tmp_path):
    sinks = Sinks.under(str(tmp_path / "out"))
    run_batch(lines([f"line {i}" for i in range(50)]), sinks, ingest_ts=NOW, buckets=3)
    index = HashIndex(spark, sinks.index)
    spark.sql(f"DROP TABLE {index.table}")
    again = HashIndex(spark, sinks.index)
    assert again.buckets == 3
    counts = run_batch(lines([f"line {i}" for i in range(50)]), sinks, ingest_ts=NOW)
    assert counts.groupBy().sum().count() == 1
    assert spark.read.text(sinks.review).count() == 50
    with pytest.raises(ValueError):
        HashIndex(spark, sinks.index, 5)


def test_several_envelopes_lose_no_record(spark):
    one, two = '{"Records":[{"a":1}]}', '{"Records":[{"b":2}]}'
    table = spark.createDataFrame([("k", f"{one}\n{two}"), ("l", f"{one} rest"), ("m", one)], "file_path string, text string")
    got = sorted(r["raw"] for r in object_lines(table).collect())
    assert got == sorted([one, two, f"{one} rest", '{"a":1}'])


def test_prefixes_of_encoded_and_repeated_names(spark, tmp_path):
    for name in ("x y/3.txt", "x y z.txt", "logs/app/logs/1.txt", "logs/other/2.txt"):
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("a\n")
    root = str(tmp_path / "logs")
    assert list_keys(spark, root, "x ").count() == 2
    assert list_keys(spark, root, "logs/ap").count() == 1


def test_repeated_hints_fail(spark, lines):
    hints = spark.createDataFrame([(0, "json"), (0, "json"), (1, "json")], "line_id long, format string")
    with pytest.raises(Exception, match="repeated key"):
        parse_batch(lines(["{}", "{}"]), hints, NOW).collect()
