import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from loglathe.functions.text import decode
from loglathe.operators.framing import frame_chunks, frame_datagrams
from loglathe.operators.unwrap import object_lines, split_text, unwrap_records
from loglathe.sources import files
from loglathe.plans.sinks import Sinks
from loglathe.sources.config import SourceConfigError, check_sources, shortest_poll, union_sources
from loglathe.streaming.run import run_stream


def raws(df):
    return sorted(r["raw"] for r in df.collect())


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\n  \r\ntwo\r\n\nlast")
    df = files.read_lines(spark, str(tmp_path))
    assert [r["raw"] for r in df.orderBy("file_path", "block_start", "line_id").collect()] == ["one", "  ", "two", "last"]
    assert files.read_lines(spark, str(tmp_path), start="latest").count() == 0
    assert files.read_lines(spark, str(tmp_path), start="latest", start_time="2000-01-01 00:00:00").count() == 4


def test_bad_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"ok\n\xff\xfe\n")
    assert raws(files.read_lines(spark, str(tmp_path), errors="replace")) == ["ok", "��"]
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path)).collect()


def test_tolerant_read_skips_corrupt_object(spark, tmp_path):
    (tmp_path / "good.gz").write_bytes(gzip.compress(b"x\ny"))
    (tmp_path / "bad.gz").write_bytes(b"not gzip")
    assert raws(files.read_lines(spark, str(tmp_path), tolerant=True)) == ["x", "y"]


def test_objects(spark, tmp_path):
    records = [{"eventName": f"E{i}", "n": None, "t": "é"} for i in range(3)]
    folder = tmp_path / "logs" / "2026"
    folder.mkdir(parents=True)
    (folder / "trail.json.gz").write_bytes(gzip.compress(json.dumps({"Records": records}).encode()))
    (folder / "empty.json").write_text('{"Records":[]}')
    (folder / "plain.txt").write_bytes("a\x0bb\r\n  c\u0085d\n".encode())
    (tmp_path / "logs" / "other.txt").write_text("no")
    want = sorted([json.dumps(r, separators=(",", ":"), ensure_ascii=False) for r in records] + ['{"Records":[]}', "a", "b", "c", "d"])
    assert raws(files.load_objects(spark, str(tmp_path), "logs/20")) == want
    assert raws(files.load_objects(spark, str(tmp_path), "logs/2026/pl")) == ["a", "b", "c", "d"]
    assert raws(files.load_objects(spark, str(tmp_path), "logs/2026/pl", envelopes=False)) == ["a", "b", "c", "d"]
    keys = files.list_keys(spark, str(tmp_path), "logs/20")
    assert keys.count() == 3
    done = keys.where(~F.col("file_path").endswith("plain.txt"))
    assert raws(files.load_objects(spark, str(tmp_path), "logs/20", processed=done)) == ["a", "b", "c", "d"]
    assert files.load_objects(spark, str(tmp_path), "logs/20", processed=keys).count() == 0


def test_unwrap_edge_cases(spark):
    texts = ['{"Records":"x"}', '{"Records":[{"a":1}, {"b":[1, "p"]}]}', "plain", '{"Records":[', ' {"Records" : [{}]} ']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")
    assert [(r["id"], r["pos"], r["raw"]) for r in unwrap_records(df).orderBy("id", "pos").collect()] == [
        (1, 0, '{"a":1}'), (1, 1, '{"b":[1,"p"]}'), (4, 0, "{}"),
    ]
    assert object_lines(df).count() == 6


def test_split_text_equals_splitlines(spark):
    rng = random.Random(5)
    alphabet = "ab \r\n\x0b\x0c\x1c\x1d\x1e\x85  \t　"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")
    got = [(r["id"], r["raw"]) for r in split_text(df).orderBy("id", "pos").collect()]
    assert got == [(i, line) for i, t in enumerate(texts) for line in t.splitlines() if line.strip()]


def test_datagrams(spark):
    rows = [(0, b"one\n\n"), (1, b"\n"), (2, b"a\nb\n"), (3, b"x\xff\r\n"), (4, b"")]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in rows], "msg_id BIGINT, payload BINARY")
    assert [(r["msg_id"], r["raw"]) for r in frame_datagrams(df).orderBy("msg_id").collect()] == [
        (0, "one"), (2, "a\nb"), (3, "x�\r"),
    ]


def test_decode_policies(spark):
    df = spark.createDataFrame([(bytearray(b"\xe9"),)], "p BINARY")
    assert df.select(decode(F.col("p"))).first()[0] == "�"
    assert df.select(decode(F.col("p"), "iso-8859-1")).first()[0] == "é"
    with pytest.raises(Exception):
        df.select(decode(F.col("p"), errors="strict")).collect()


def reference_lines(data: bytes):
    return [t for t in (piece.decode("utf-8", "replace").strip() for piece in data.split(b"\n")) if t]


@pytest.mark.parametrize("size, block", [(1, 3), (7, 2), (37, 65536), (4096, 4)])
def test_chunks(spark, size, block):
    streams = {
        0: "é1\n\n  second \r\nthird　\nno end é".encode(),
        1: b"\n\n\n",
        2: ("x" * 300 + "\n").encode() * 5 + b"tail",
        3: "\n".join(f"line {i} ü" for i in range(200)).encode() + b"\n",
        4: b"single",
        5: b"\xff\xfe\nok\n\xe2\x82",
    }
    rows = [
        (conn, i // size, bytearray(data[i : i + size])) for conn, data in streams.items() for i in range(0, len(data), size)
    ]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conn_id BIGINT, seq BIGINT, payload BINARY")
    got = frame_chunks(df, block=block).orderBy("conn_id", "after_seq", "after_idx").collect()
    for conn, data in streams.items():
        assert [r["raw"] for r in got if r["conn_id"] == conn] == reference_lines(data), conn


def test_detect_files(spark, tmp_path):
    event = "<Event>\n<System>\n<EventID>1</EventID>\n</System></Event>\n"
    contents = {
        "a.xml": "\n  \n<Event></Event>\n" + event,
        "b.txt": "<Event></Event>\n" + event,
        "far.log": "<a></a>\n" + "x" * 2000 + "\n" + event,
        "near.log": "<a></a>\n" + "\n" * 1500 + event,
        "empty.log": "",
        "blank.log": " \n\t\n",
        "k.log": "\n\na=1 b=2 c=3\nCEF:0|x\n",
    }
    for name, text in contents.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bin.EVTX").write_bytes(b"ElfFile\x00\xff")
    got = {r["file_path"].rsplit("/", 1)[1]: r for r in files.detect_files(spark, str(tmp_path)).collect()}
    assert {n: (r["format"], r["confidence"]) for n, r in got.items()} == {
        "a.xml": ("evtx_xml", 1.0), "b.txt": ("xml", 1.0), "far.log": ("xml", 1.0), "near.log": ("evtx_xml", 1.0),
        "empty.log": ("unknown", 0.0), "blank.log": ("unknown", 0.0), "k.log": ("kv", 0.85), "bin.EVTX": ("evtx_xml", 1.0),
    }
    assert got["bin.EVTX"]["raw_sample"] == "[binary EVTX file: bin.EVTX]"
    assert got["empty.log"]["raw_sample"] == "[empty file]" and got["k.log"]["raw_sample"] == "a=1 b=2 c=3"
    with pytest.raises(Exception):
        files.detect_files(spark, str(tmp_path / "missing")).collect()


def test_declared_sources(spark, tmp_path):
    (tmp_path / "f.log").write_text("file line\n")
    captured = str(tmp_path / "captured")
    spark.createDataFrame([(bytearray(b"packet\n"),)], "payload BINARY").write.parquet(captured)
    bucket = tmp_path / "bucket" / "logs"
    bucket.mkdir(parents=True)
    (bucket / "o.json").write_text('{"Records":[{"a":1}]}')
    df = union_sources(spark, [
        {"type": "file", "path": str(tmp_path / "f.log")},
        {"type": "syslog", "name": "udp", "path": captured},
        {"type": "s3", "bucket": str(tmp_path / "bucket"), "prefix": "logs/"},
    ])
    assert {(r["source"], r["source_rank"], r["raw"]) for r in df.collect()} == {
        ("FileConnector", 0, "file line"), ("udp", 1, "packet"), ("S3Connector", 2, '{"a":1}'),
    }


def test_declared_sources_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.log").write_text("one\ntwo\n")
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "o.json").write_text('{"Records":[{"a":1}]}')
    captured = str(tmp_path / "captured")
    spark.createDataFrame([(bytearray(b"packet\n"),)], "payload BINARY").write.parquet(captured)
    blocks = [
        {"type": "file", "path": str(tmp_path / "in"), "poll_interval": 2},
        {"type": "file", "name": "late", "path": str(tmp_path / "in"), "tail": True},
        {"type": "s3", "bucket": str(tmp_path / "bucket"), "delete_after_read": True},
        {"type": "syslog", "path": captured, "poll_interval": 1},
    ]
    assert shortest_poll(blocks) == 0.25
    sinks = Sinks.under(str(tmp_path / "out"))
    run_stream(union_sources(spark, blocks, streaming=True), sinks, str(tmp_path / "cp"), ingest_ts="2026-01-01T00:00:00+00:00").awaitTermination()
    found = spark.read.text(sinks.review).select(F.get_json_object("value", "$.raw").alias("raw"))
    assert raws(found) == ["one", "packet", "two", '{"a":1}']
    with pytest.raises(SourceConfigError):
        union_sources(spark, [{"type": "syslog", "protocol": "tcp", "path": captured}], streaming=True)


@pytest.mark.parametrize("blocks", [
    {}, ["x"], [{}], [{"type": "file"}], [{"type": "file", "path": "x", "poll_interval": 0}], [{"type": "s3"}],
    [{"type": "syslog", "protocol": "icmp"}], [{"type": "syslog", "port": 70000}],
])
def test_bad_declarations(blocks):
    with pytest.raises(SourceConfigError):
        check_sources(blocks)


def test_unknown_type(spark):
    with pytest.raises(SourceConfigError):
        union_sources(spark, [{"type": "nope"}])
