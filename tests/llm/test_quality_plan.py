import zlib

import pytest
from loglathe.llm import quality


def test_table_of_ratios_is_not_spelled_out_in_plans(spark):
    texts = ["", "one", "two one two", *(f"word{i} {i} some other words" for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = docs.where("doc_id % 3 = 0").select("doc_id")
    done = quality.scored(docs, trusted)
    assert len(done._jdf.queryExecution().toString()) < 100_000

    table = quality.ratios(docs, docs.where("doc_id % 3 = 0"))
    level = lambda term: (table[term] - quality.MIDDLE) / quality.PER_UNIT
    for row in done.collect():
        codes = [zlib.crc32(w.encode()) for w in row["text"].split()]
        terms = [c % quality.BUCKETS for c in codes]
        terms += [(a * 31 + b) % quality.BUCKETS + quality.BUCKETS for a, b in zip(codes, codes[1:])]
        assert row["ratio"] == pytest.approx(sum(map(level, terms)) / max(len(terms), 1))
