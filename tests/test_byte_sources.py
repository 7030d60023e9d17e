"""Byte-level sources against Python's own reading of the same files."""

import gzip
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loglathe.operators.unwrap import object_lines
from loglathe.sources import envelopes, files, heads
from loglathe.sources.config import union_sources
from loglathe.sources.byte_lines import ByteLines, Coding, lines_of


def _python_lines(data: bytes, encoding: str) -> list[str]:
    text = io.TextIOWrapper(io.BytesIO(data), encoding, "replace", newline=None).read()
    return [line for line in text.split("\n") if line]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16", "utf-16-be", "utf-32", "cp1252", "utf-8-sig", "shift_jis"])
def test_any_cut_gives_every_line_once(encoding):
    rnd = random.Random(encoding)
    letters = "ab é" if encoding != "shift_jis" else "ab 表"
    for _ in range(60):
        text = "".join(rnd.choice([*letters, "\n", "\r", "\r\n", "\n\n"]) for _ in range(rnd.randint(0, 60)))
        data = text.encode(encoding)
        coding = Coding.of(encoding, data[:4])
        step = rnd.choice([1, 2, 3, 5, 100]) * coding.width
        got = []
        for a in range(0, len(data), step):
            part = lines_of(lambda at, n: data[at : at + n], coding, a, min(a + step, len(data)), len(data))
            got += [line.decode(coding.name) for _, line in part]
        assert [g for g in got if g] == _python_lines(data, encoding), (text, step)


def test_byte_lines(spark, tmp_path):
    spark.dataSource.register(ByteLines)
    lines = [f"Zeile {i} äöü {'x' * (i % 50)}" for i in range(3000)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.log").write_bytes("\r\n".join(lines).encode("latin-1"))
    (tmp_path / "c.log.gz").write_bytes(gzip.compress("\n".join(lines[:10]).encode("latin-1")))
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    read = spark.read.format("byte_lines").option("encoding", "latin-1").option("rangeBytes", 1000).load(str(tmp_path))
    rows = read.collect()
    assert sorted(r["raw"] for r in rows) == sorted(lines + lines[:10])
    plain = sorted((r["block_start"], r["raw"]) for r in rows if r["file_path"].endswith("a%20b.log"))
    assert [r for _, r in plain] == lines
    assert {r["file_path"] for r in rows} == {r["file_path"] for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path))
                                             .select(F.col("_metadata.file_path").alias("file_path")).collect()}
    (tmp_path / "bad.log").write_bytes(b"ok\n\xff\n")
    with pytest.raises(Exception):
        spark.read.format("byte_lines").load(str(tmp_path / "bad.log")).collect()
    loose = spark.read.format("byte_lines").option("errors", "replace").load(str(tmp_path / "bad.log"))
    assert sorted(r["raw"] for r in loose.collect()) == ["ok", "�"]


def test_growing_files(spark, tmp_path):
    spark.dataSource.register(ByteLines)
    source, out = tmp_path / "in", []
    source.mkdir()
    (source / "a.log").write_bytes(b"one\ntwo\nbeg")

    def run(start="earliest", checkpoint="cp"):
        stream = spark.readStream.format("byte_lines").option("start", start).option("rangeBytes", 4).load(str(source))
        seen = []
        (stream.writeStream.foreachBatch(lambda df, n: seen.extend(r["raw"] for r in df.collect()))
         .option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination())
        return sorted(seen)

    assert run() == ["one", "two"]
    with (source / "a.log").open("ab") as f:
        f.write(b"un\nthree\n")
    (source / "b.log").write_bytes(b"other\n")
    assert run() == ["begun", "other", "three"] and run() == []
    (source / "a.log").write_bytes(b"new\n")  # rotated in place
    os.remove(source / "b.log")
    assert run() == ["new"]
    assert run("latest", "late") == []
    with (source / "a.log").open("ab") as f:
        f.write(b"after\n")
    assert run("latest", "late") == ["after"]


def _brute_envelope(text: str) -> list[str]:
    stripped = text.strip()
    try:
        doc = json.loads(stripped, parse_constant=lambda _: 1 / 0) if stripped.startswith("{") else None
    except (ValueError, ZeroDivisionError):
        doc = None
    if isinstance(doc, dict) and isinstance(doc.get("Records"), list) and doc["Records"]:
        return [json.dumps(r, separators=(",", ":"), ensure_ascii=False) for r in doc["Records"]]
    return [line for line in text.splitlines() if line.strip()]


ENVELOPES = [
    '{"Records":["s",null,{"a":1},[1, 2],3.5,true,"q\\"u,}]"]}', ' {"x":{"Records":[1]},"Records" : [ {"b":"{[,"} ] } \n', '{"Records":[]}',
    '{"Records":"x"}', '{"Records":[1]} rest', '{"Records":[1]}\n{"Records":[2]}', '{"Records":[1,]}', '{"Records":[1 2]}', '{"Records":[NaN]}',
    '{"Records":[1],"Records":[2,3]}', '{"Records":[1],"Records":7}', '{"Records":[{"a":}]}', '{"Records":[1', "{}", '{"a":1,}', "plain\r\nlines\x85\n", "",
    '[{"Records":[1]}]', '{"Records":[1],"o":tru}', '{"Records":["é\\u00e9"]}', '{1:2,"Records":[1]}', '{"Records":[[],{}]}', '{"Records":[[1,{"x":[2]}],{}],"n":-1e5}',
]


@pytest.mark.parametrize("block", [1, 3, 1 << 18])
def test_envelopes_as_whole_reading_has_them(monkeypatch, block):
    monkeypatch.setattr(envelopes, "BLOCK_BYTES", block)
    for text in ENVELOPES:
        got = list(envelopes.lines(lambda: io.BytesIO(text.encode())))
        assert got == _brute_envelope(text), text


def test_large_envelope(spark, tmp_path):
    with gzip.open(tmp_path / "big x.json.gz", "wt") as f:
        f.write('{"Records":[' + ",".join(f'{{"n":{i}}}' for i in range(50_000)) + "]}")
    (tmp_path / "plain.txt").write_text("a\n\nb")
    (tmp_path / "latin.txt").write_bytes("ä\n".encode("latin-1"))
    rows = files.load_objects(spark, str(tmp_path))
    assert rows.columns == ["file_path", "block_start", "line_id", "raw"]
    assert sorted(r["raw"] for r in rows.collect()) == sorted([*(f'{{"n":{i}}}' for i in range(50_000)), "a", "b", "\ufffd"])
    latin = files.load_objects(spark, str(tmp_path), "lat", encoding="latin-1")
    assert [r["raw"] for r in latin.collect()] == ["ä"]
    assert files.load_objects(spark, str(tmp_path), "plain", envelopes=False).columns == rows.columns
    (tmp_path / "bad.gz").write_bytes(b"no gzip")
    with pytest.raises(Exception):
        files.load_objects(spark, str(tmp_path)).collect()
    assert files.load_objects(spark, str(tmp_path), "bad", tolerant=True).count() == 0


def test_whole_objects_keep_texts_and_nulls(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate(ENVELOPES)], "k int, text string")
    got = {}
    for r in object_lines(table).orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append(r["raw"])
    for k in (0, 1, 2, 3, 4, 5, 15, 17):
        assert got.get(k, []) == _brute_envelope(ENVELOPES[k]), ENVELOPES[k]


def test_objects_that_fail_are_tried_again(spark, tmp_path):
    source, keys = tmp_path / "in", files.ProcessedKeys(spark, str(tmp_path / "keys"), 2)
    source.mkdir()
    (source / "a.log").write_text("one\n")
    (source / "b.gz").write_bytes(b"broken")
    (source / "c.gz").write_bytes(gzip.compress(b"x\n" * 100_000)[:-20])
    seen = []

    def run(batch_id):
        outcome = files.take_objects(spark, str(source), keys, lambda df: seen.extend(r["raw"] for r in df.collect()), batch_id)
        return {r["file_path"].rsplit("/", 1)[1]: r["error"] is None for r in outcome.collect()}

    assert run(0) == {"a.log": True, "b.gz": False, "c.gz": False} and seen == ["one"]
    (source / "b.gz").write_bytes(gzip.compress(b"two\n"))
    assert run(1) == {"b.gz": True, "c.gz": False} and seen == ["one", "two"]
    assert run(1) == {"b.gz": True, "c.gz": False} and seen == ["one", "two", "two"]  # a lost run again
    assert run(2) == {} and seen == ["one", "two", "two"]


class _Counted(io.BytesIO):
    count = 0

    def read(self, n=-1):
        data = super().read(n)
        self.count += len(data)
        return data


def test_heads_read_no_further_than_needed(monkeypatch):
    data = _Counted(b"  \r\n\n first line \n" + b"x" * 1_000_000)
    assert heads.first_line(data, 0)[0] == "first line" and data.count <= heads.BLOCK_BYTES
    data = _Counted(b"a\n" + b"y" * 1_000_000)
    line, head, count = heads.first_line(data, 2000)
    assert (line, len(head), count) == ("a", 2000, heads.BLOCK_BYTES)
    rnd = random.Random(4)
    for block in (1, 2, 7, 8192):
        monkeypatch.setattr(heads, "BLOCK_BYTES", block)
        for _ in range(200):
            text = "".join(rnd.choice(["a", "é", " ", "\n", "\r", "\r\n", "\t"]) for _ in range(rnd.randint(0, 15)))
            whole = text.replace("\r\n", "\n").replace("\r", "\n")
            want = next((p.strip() for p in whole.split("\n") if p.strip()), None)
            line, head, _ = heads.first_line(io.BytesIO(text.encode()), 6)
            assert (line, head) == (want, whole[:6]), (text, block)


def test_unreadable_files_are_named(spark, tmp_path):
    (tmp_path / "bad.gz").write_bytes(b"no gzip")
    (tmp_path / "ok.log.gz").write_bytes(gzip.compress(b"\n a=1 b=2 c=3\n"))
    got = {r["file_path"].rsplit("/", 1)[1]: r for r in files.detect_files(spark, str(tmp_path)).collect()}
    assert got["ok.log.gz"]["format"] == "kv"
    assert got["bad.gz"]["raw_sample"].startswith("[error reading file: ") and got["bad.gz"]["format"] == "unknown"
    with pytest.raises(Exception):
        files.detect_files(spark, str(tmp_path), tolerant=False).collect()


def test_heads_equal_the_scan(spark, tmp_path):
    rnd = random.Random(6)
    pieces = ["<Event></Event>", "<a></a>", "<System>", "<EventID>1</EventID>", "a=1 b=2 c=3", "plain é", "{", "", "  ", "\t", "CEF:0|x", "y" * 900]
    for k in range(60):
        text = rnd.choice(["\n", "\r\n"]).join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9)))
        (tmp_path / f"{k} é{rnd.choice(['.log', '.xml', '.txt', '', '.evtx'])}").write_bytes(text.encode())
    a = files._detect_heads(spark, [str(tmp_path)], True)
    b = files._detect_scan(spark, str(tmp_path), True)
    assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_declared_encodings(spark, tmp_path):
    (tmp_path / "f.log").write_bytes("größe\n".encode("utf-16"))
    (tmp_path / "bucket").mkdir()
    (tmp_path / "bucket" / "o.json").write_bytes('{"Records":[{"a":"ü"}]}'.encode("latin-1"))
    got = union_sources(spark, [
        {"type": "file", "path": str(tmp_path / "f.log"), "encoding": "utf-16"},
        {"type": "s3", "bucket": str(tmp_path / "bucket"), "encoding": "latin-1"},
    ])
    assert {r["raw"] for r in got.collect()} == {"größe", '{"a":"ü"}'}
