"""Framing by keyed state: order, close, reuse of a name, idle connections."""

import time

import pyarrow as pa
import pytest

from loglathe.streaming import connections
from loglathe.streaming.connections import STORE, STORE_SETTING, frame_connections

from .test_sources import reference_lines

SCHEMA = "conn_id BIGINT, seq BIGINT, payload BINARY"


@pytest.fixture
def framed(spark, tmp_path):
    """Runs the given files as micro-batches, on top of those of earlier calls; lines of all of them, in order."""
    before = spark.conf.get(STORE_SETTING)
    spark.conf.set(STORE_SETTING, STORE)
    source, out, offsets = (str(tmp_path / n) for n in ("chunks", "out", "offsets"))

    def run(*parts, **options):
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            time.sleep(0.05)  # files are taken by age
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        lines = frame_connections(stream, **options)
        to = lines.writeStream.option("checkpointLocation", offsets).trigger(availableNow=True)
        to.format("parquet").start(out).awaitTermination()
        got = spark.read.schema(lines.schema).parquet(out).collect()
        return sorted(got, key=lambda r: (r["conn_id"], -1 if r["after_seq"] is None else r["after_seq"], r["after_idx"]))

    run.state = lambda name: spark.read.format("statestore").option("path", offsets).option("stateVarName", name).load()
    yield run
    spark.conf.set(STORE_SETTING, before)


def raws(rows, conn):
    return [r["raw"] for r in rows if r["conn_id"] == conn]


@pytest.mark.parametrize("size", [1, 5, 400])
def test_lines_of_connections_and_empty_state_after_close(framed, size):
    data = {
        1: "first é\nsecond\n\nthird open".encode() + b" end\nlast",
        2: b"one long line without any feed",
        3: b"\n\n  \n",
        4: b"a\nb\nc\xff\n",
    }
    rows = [(c, i // size, bytearray(d[i : i + size])) for c, d in data.items() for i in range(0, len(d), size)]
    last = max(r[1] for r in rows)
    thirds = [[r for r in rows if r[1] * 3 // (last + 1) == k][::-1] for k in range(3)]
    ends = [(c, last, None) for c in data]
    got = framed(*[t for t in thirds if t], ends)
    for conn, bytes_ in data.items():
        assert raws(got, conn) == reference_lines(bytes_)
    assert framed.state("began").count() == 0


def test_open_line_waits_and_name_is_used_again(framed):
    got = framed([(1, 0, bytearray(b"x\nop")), (1, 1, bytearray(b""))])
    assert raws(got, 1) == ["x"] and framed.state("began").count() == 1
    got = framed([(1, 2, bytearray(b"en")), (1, 3, None), (1, 4, bytearray(b"aga"))], [(1, 5, bytearray(b"in")), (9, 0, None)])
    assert {(r["after_seq"], r["raw"]) for r in got} == {(None, "x"), (0, "open")}
    assert framed.state("began").count() == 0
    got = framed([(1, 6, None)])
    assert {(r["after_seq"], r["raw"]) for r in got} == {(None, "x"), (0, "open"), (None, "again")}


def test_idle_connections_close(framed, spark, tmp_path):
    source, out = str(tmp_path / "chunks"), str(tmp_path / "out")
    spark.createDataFrame([(1, 0, bytearray(b"x\nopen"))], SCHEMA).write.parquet(source)
    lines = frame_connections(spark.readStream.schema(SCHEMA).parquet(source), idle_seconds=0.5)
    to = lines.writeStream.option("checkpointLocation", str(tmp_path / "offsets")).trigger(processingTime="1 second")
    running = to.format("parquet").start(out)
    try:
        for _ in range(60):
            time.sleep(0.5)
            got = {r["raw"] for r in spark.read.schema(lines.schema).parquet(out).collect()}
            if len(got) == 2:
                break
    finally:
        running.stop()
    assert got == {"x", "open"}
    assert framed.state("began").count() == 0


def test_other_state_store_is_refused(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value conn_id", "value seq", "CAST('a' AS BINARY) payload")
    with pytest.raises(ValueError, match="providerClass"):
        frame_connections(stream)


def test_chunks_of_a_connection_in_a_batch_go_to_the_state_as_one_row():
    names = ["conn_id", *connections._ENDS]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
    schema = pa.schema([*zip(names, kinds)])
    chunks = [(c, s, s == 7, s % 3, b"h%d" % s, None if s == 7 else b"t") for s in (3, 0, 7) for c in (5, None, 2)]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in chunks], schema)
    got = [row for b in connections._packed(iter([batch, batch.slice(0, 0)])) for row in b.to_pylist()]
    assert sorted(r["conn_id"] or -1 for r in got) == [-1, 2, 5]
    back = [(r["conn_id"], *ends) for r in got for ends in zip(*(r[name] for name in connections._ENDS))]
    assert sorted(back, key=repr) == sorted(chunks, key=repr)
