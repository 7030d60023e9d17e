"""Plans that are built once for all micro-batches, and outputs that are written side by side."""

import os

import py4j.java_gateway
import pytest
from pyspark.sql import functions as F

from loglathe import RunLedger, Sinks, parse, run_batch
from loglathe.operators.replay import replayed
from loglathe.plans.sinks import to_cef, to_ocsf

from .conftest import NOW

LINES = [
    "May  9 14:23:05 prod-server-01 sshd[22342]: Failed password for root from 203.0.113.99 port 41512 ssh2",
    '{"timestamp":"2026-05-09T14:23:35Z","eventName":"GetObject","sourceIPAddress":"10.10.1.50"}',
    "nothing known",
]


@pytest.fixture
def calls(monkeypatch):
    """Calls from Python into the JVM."""
    seen = []
    real = py4j.java_gateway.JavaMember.__call__
    monkeypatch.setattr(py4j.java_gateway.JavaMember, "__call__", lambda self, *a: (seen.append(1), real(self, *a))[1])
    return seen


def test_plan_of_a_later_micro_batch_takes_few_calls(lines, calls):
    def built(rows):
        del calls[:]
        events = parse(lines(rows), ingest_ts=NOW)
        plans = events, to_ocsf(events), to_cef(events)
        return plans, len(calls)

    built(LINES[:1])
    plans, again = built(LINES)
    assert again < 400
    assert sorted(r["raw"] for r in plans[0].collect()) == sorted(LINES)
    assert plans[1].count() == plans[2].count() == len(LINES)


def test_replay_is_bound_to_key_and_columns(spark):
    def adding(n):
        return lambda df: df.withColumn("y", F.col("x") + n)

    one, two = spark.createDataFrame([(1,)], "x INT"), spark.createDataFrame([(5, "a")], "x INT, z STRING")
    for _ in range(2):
        assert [tuple(r) for r in replayed(one, ("add", 1), adding(1)).collect()] == [(1, 2)]
        assert [tuple(r) for r in replayed(one, ("add", 2), adding(2)).collect()] == [(1, 3)]
        assert [tuple(r) for r in replayed(two, ("add", 1), adding(1)).collect()] == [(5, "a", 6)]
    with pytest.raises(AttributeError, match="replayed"):
        replayed(one, "grouped", lambda df: df.groupBy("x"))


def test_output_that_fails_leaves_run_without_marker_and_index(spark, lines, tmp_path):
    sinks = Sinks.under(str(tmp_path / "out"))
    os.makedirs(tmp_path / "out")
    (tmp_path / "out" / "cef").write_text("a file where the folder should be")
    with pytest.raises(Exception):
        run_batch(lines(LINES), sinks, ingest_ts=NOW)
    assert RunLedger(spark, sinks.runs).done() == set()
    assert not [n for n in os.listdir(sinks.index) if n.endswith(".parquet")]
    os.remove(tmp_path / "out" / "cef")
    run_batch(lines(LINES), sinks, ingest_ts=NOW)
    assert sum(spark.read.text(folder).count() for folder in (sinks.confident, sinks.review)) == len(LINES)
    assert RunLedger(spark, sinks.runs).done() == {0}
