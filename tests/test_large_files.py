"""Files of queries, and envelopes, at sizes where tasks have to share the work."""

from __future__ import annotations

import gzip
import json
import re

from pyspark.sql import functions as F

from checks import files as written
from loglathe.sources import envelopes
from loglathe.sources.files import list_keys, load_objects


def _contents(path, opened=open):
    return {p.name: opened(p, "rt", encoding="utf-8", newline="").read() for p in path.iterdir()}


def test_a_file_for_each_key(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3 if k else None, k, f"é{k}") for k in range(100)], "k long, n long, value string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files go on over batches
    try:
        written.write_files(rows, f"file://{tmp_path}/a", "k", "n", suffix=".txt.gz")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {f"k={r}.txt.gz": "".join(f"é{k}\n" for k in range(1, 100) if k % 3 == r) for r in range(3)}
    assert _contents(tmp_path / "a", gzip.open) == {**want, f"k={written.NO_KEY}.txt.gz": "é0\n"}


def test_spark_writes_where_tasks_reach_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(written, "reachable", lambda path: False)
    rows = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("value"))
    written.write_files(rows, f"file://{tmp_path}/a", "k", begin="<", between=",", end=">\n")
    texts = sorted(p.read_text().strip("\0\n") for p in (tmp_path / "a").glob("k=*/*.txt"))
    assert texts == ["<0,2,4,6,8>", "<1,3,5,7,9>"]


def test_each_large_object_has_its_own_task(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"{k}.json").write_text(json.dumps({"Records": [{"k": k}] * (k + 1)}))
    for _ in range(3):
        read = envelopes.read_keys(list_keys(spark, str(tmp_path))).select(F.spark_partition_id().alias("task"))
        assert read.distinct().count() == 4


def test_records_are_read_in_place(monkeypatch):
    by_text, value = [], envelopes._Scanner.value
    monkeypatch.setattr(envelopes._Scanner, "value", lambda self: by_text.append(0) or value(self))
    text = json.dumps({"Records": [{"n": n, "t": ["é", None]} for n in range(50)]})
    assert [r for _, r in envelopes.records(iter([text])) if r][7] == '{"n":7,"t":["é",null]}'
    assert not by_text


def test_any_cut_gives_the_same_records():
    text = '{"a":{"b":"]"},"Records":[ {"n":1.5e3,"s":"\\"}"}, "x,\\u00e9" ,-1.25e-3,[1,[2]],true,12] , "z":0}'
    want = list(envelopes.records(iter([text])))
    assert [json.loads(r) for _, r in want if r] == [{"n": 1500.0, "s": '"}'}, "x,é", -0.00125, [1, [2]], True, 12]
    for size in range(1, len(text)):
        assert list(envelopes.records(iter(re.findall(f"(?s).{{1,{size}}}", text)))) == want


def test_envelopes_of_a_key(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 3).alias("part"), F.concat(F.lit('{"n" : '), "id", F.lit("}")).alias("value"))
    written.write_files(rows, f"file://{tmp_path}/e", "part", begin='{"Records":[', between=",\n", end="]}\n", suffix=".json")
    got = load_objects(spark, f"file://{tmp_path}/e").select("raw").collect()
    assert sorted(r["raw"] for r in got) == sorted(f'{{"n":{n}}}' for n in range(1000))
