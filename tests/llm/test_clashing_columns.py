"""Users' columns named like the operators' own stay as they are."""

import random

import pytest

from loglathe.llm import mixing, pseudonyms, secrets

NAMES = ["spans", "mix_mark", "mix_doc", "_base", "_spans", "_runs", "_found", "_words", "_email", "_new", "_date", "kept", "ratio",
         "n_words", "apart", "a.b", "doc", "nth", "src", "stream", "mark", "times", "size", "low"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    text = lambda k: " ".join("".join(rng.choice("abcdeo") for _ in range(5)) for _ in range(80)) + f" a{k}@b.org token = '0a1b2c3d4e5f6071'"
    rows = [(k, text(k), "s", 1, *[f"{n}{k}" for n in NAMES]) for k in range(12)]
    columns = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, columns).cache()


def _quality(table, path):
    import corpus_pipeline

    table.sparkSession.range(12).selectExpr("id AS doc_id", "1 AS quality").write.parquet(f"{path}/labels.parquet")
    return corpus_pipeline.quality(table.sparkSession, table, path)


STAGES = {
    "mixing": lambda t, p: mixing.mixed_documents(t),
    "secrets": lambda t, p: secrets.redacted(t),
    "pseudonyms": lambda t, p: pseudonyms.pseudonymized(t, "k").select(*[f"`{c}`" for c in t.columns]),
    "quality": _quality,
}


@pytest.mark.parametrize("stage", STAGES)
def test_users_columns_stay(table, tmp_path, stage):
    done = STAGES[stage](table, str(tmp_path))
    assert done.columns == table.columns
    rows = done.collect()
    assert {r["doc_id"] for r in rows} == set(range(12))
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES)


def test_near_dedup_stage_loses_no_text_of_an_id(spark):
    import corpus_pipeline

    words = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(4)]
    rows = [(1, words[0], "a"), (1, words[1], "b"), (1, words[0], "c"), (2, words[1], "d"), (3, words[2], "e"),
            (None, words[3], "f"), (None, words[3], "g"), (4, "", "h"), (5, None, "i")]
    docs = spark.createDataFrame([(i, t, x, x) for i, t, x in rows], "doc_id long, text string, apart string, text_key string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted(
        [(1, words[0]), (1, words[1]), (3, words[2]), (0, words[3]), (0, words[3]), (4, ""), (5, "")]
    )
