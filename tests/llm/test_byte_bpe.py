"""Ids against the library that defines them, text against Python's own decoder."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from loglathe.llm import byte_bpe, transducer, utf8

PATHS = [public_tokenizers.path(f"byte_bpe_{n}.tiktoken") for n in ("50k", "multi_50k")]
PATTERN = public_tokenizers.PATTERN


class Coder:
    def __init__(self, path: str) -> None:
        ranks = transducer.read_ranks(path)
        coder = byte_bpe.Encoder(ranks, PATTERN)
        self.transducer, self.encode, self.decode = coder.transducer, coder.encode, byte_bpe.Decoder(ranks).decode


@pytest.fixture(scope="module", params=PATHS)
def both(request):
    ranks = transducer.read_ranks(request.param)
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Coder(request.param), theirs


def _texts(n: int) -> list[str]:
    rnd = random.Random(11)
    letters = [
        lambda: rnd.choice("etaoin shr'stl"),
        lambda: chr(rnd.randint(0, 0x2FF)),
        lambda: chr(rnd.choice([rnd.randint(0x370, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])),
        lambda: rnd.choice(" \t\n\r\x0b\x1c\x85\xa0 　'0²٣ªſ"),
    ]
    out = ["", " ", "\n\n \n", "a" * 10_000, " " * 9_000 + "x", "ab" * 6_000, "don't've'LL", "<|endoftext|>", "՘ab \U00016ff4"]
    for _ in range(n):
        pick = rnd.choice([letters, letters[:1], letters[1:2]])
        out.append("".join(rnd.choice(pick)() for _ in range(rnd.randint(1, 60))))
    return out


def _ids(value: bytes) -> list[int]:
    return np.frombuffer(value, "<u4").tolist()


def test_ids_are_those_of_the_library(both):
    ours, theirs = both
    for text in _texts(3000):
        ids = ours.encode(text)
        assert _ids(ids) == theirs.encode_ordinary(text), text
        assert ours.decode(ids) == text.encode()


def test_pieces_of_any_bytes(both):
    ours, theirs = both
    rnd = random.Random(3)
    tokens = list(ours.transducer.ranks)
    for _ in range(2000):
        piece = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 6)))
        assert ours.transducer.encode(piece) == theirs._encode_single_piece(piece)
        assert ours.transducer.merged(piece) == theirs._encode_single_piece(piece)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(transducer, "STATES", 50)
    monkeypatch.setattr(transducer, "PAIRS", 50)
    monkeypatch.setattr(transducer, "HELD", 3)
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 20)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 30)
    monkeypatch.setattr(byte_bpe, "STEP", 5)
    ours = Coder(PATHS[0])
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ours.transducer.ranks, special_tokens={})
    for text in _texts(300):
        ids = ours.encode(text)
        assert _ids(ids) == theirs.encode_ordinary(text), text
        assert ours.decode(ids) == text.encode()


def test_any_small_vocabulary():
    """Merges of random vocabularies, checked against merging by definition; every token is made by merges."""
    rnd = random.Random(5)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        held = [b"a", b"b", b"c"]
        while len(held) < 25:
            joined = rnd.choice(held) + rnd.choice(held)
            if joined not in ranks:
                ranks[joined] = len(ranks)
                held.append(joined)
        machine = transducer.Transducer(ranks)
        if any(machine.merged(t) != [r] for t, r in ranks.items()):
            continue  # such a token never comes out of merging; files of ranks have none
        for _ in range(200):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 40)))
            assert machine.encode(data) == machine.merged(data)


def test_state_machine_decodes_as_python_does():
    rnd = random.Random(8)
    some = [0x41, 0x80, 0xBF, 0xC0, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE4, 0xB8, 0xAD]
    tokens = utf8.TokenText({b: bytes([b]) for b in range(256)})
    for _ in range(5000):
        data = bytes(rnd.choice(some) for _ in range(rnd.randint(0, 12)))
        want = data.decode("utf-8", "replace").encode()
        reader, lifted, at, out, out2 = utf8.Utf8(), utf8.Utf8(), 0, b"", b""
        while at < len(data):
            n = rnd.randint(1, 4)
            out += reader.feed(data[at : at + n])
            out2 += tokens.feed(np.frombuffer(data[at : at + n], np.uint8).astype(np.uint32), lifted)
            at += n
        assert out + reader.close() == want
        assert out2 + lifted.close() == want


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("ids", T.StringType()),
        T.StructField("_source", T.IntegerType()),
    ]
)


def test_tables(spark):
    long = "Grüße, wörld! " * 40_000
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, None, None), (3, "", "", 0), (None, "é\U0001f600", "y", 2), (4, long, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = byte_bpe.encode(docs, PATHS[0], PATTERN, ["doc_id", "_source"])
    assert ids.columns == ["doc_id", "_source", "ids"]
    back = byte_bpe.decode(ids, PATHS[0], ["doc_id", "_source", "ids"])
    got = back.collect()
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=transducer.read_ranks(PATHS[0]), special_tokens={})
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert all(_ids(bytes(r["ids"])) == theirs.encode_ordinary(r["text"]) for r in got)
    empty = byte_bpe.encode(docs.limit(0), PATHS[0], PATTERN, ["doc_id"])
    assert empty.collect() == [] and byte_bpe.decode(empty, PATHS[0], []).collect() == []
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, PATHS[0], PATTERN, ["ids"])


def test_ids_and_bytes_that_stand_for_nothing(spark):
    known = transducer.read_ranks(PATHS[0])
    half = np.array([known[b"\xe2"], 4_000_000_000, known[b"a"]], "<u4").tobytes()
    rows = [(1, bytearray(half + b"\x01\x02")), (2, None)]
    got = byte_bpe.decode(spark.createDataFrame(rows, "k int, ids binary"), PATHS[0], ["k"]).collect()
    assert {r["k"]: r["text"] for r in got} == {1: "��a", 2: ""}
    broken = spark.sql("SELECT 1 AS k, CAST(X'61FF62' AS STRING) AS text")
    ids = byte_bpe.encode(broken, PATHS[0], PATTERN, ["k"])
    assert byte_bpe.decode(ids, PATHS[0], ["k"]).first()["text"] == "a�b"


def test_one_worker_encodes_and_decodes(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", *_texts(40)])], "doc_id long, text string")
    both = byte_bpe.recode(docs, PATHS[0], PATTERN, ["doc_id"])
    ids = byte_bpe.encode(docs, PATHS[0], PATTERN, ["doc_id"])
    apart = byte_bpe.decode(ids, PATHS[0], ["doc_id", "ids"]).withColumnRenamed("text", "decoded")
    assert both.columns == apart.columns and sorted(both.collect()) == sorted(apart.collect())
    assert all(r["decoded"] == (t or "") for r, t in zip(sorted(both.collect()), [None, "", *_texts(40)]))
    with pytest.raises(ValueError, match="decoded"):
        byte_bpe.recode(docs, PATHS[0], PATTERN, ["decoded"])


def test_query_starts_one_worker_for_a_task(spark, tmp_path):
    from loglathe.llm.queries import coded

    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = coded(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
