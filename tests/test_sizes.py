"""What keeps tasks, memory and state small on large tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from checks import corpus
from loglathe.operators import extraction
from loglathe.streaming import connections


def _most(df):
    return df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count")).first()[0]


def test_rows_are_dealt_where_parts_are_many_but_uneven(spark):
    uneven = spark.range(0, 800, 1, 8).where("id < 100")  # all rows in the first of eight parts
    dealt = corpus.spread(uneven)
    assert _most(dealt) <= 20
    assert sorted(r.id for r in dealt.collect()) == list(range(100))


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_ROWS", 100)
    assert corpus.spread(spark.range(0, 4000, 1, 4)).rdd.getNumPartitions() == 4 * 10


def test_even_parts_stay(spark):
    even = spark.range(0, 800, 1, 8)
    assert corpus.spread(even) is even


class _State:
    """A value and a list in one, which counts the calls."""

    calls = 0

    def __init__(self):
        self.value, self.rows = None, []

    def __getattr__(self, name):
        done = {
            "exists": lambda: self.value is not None or bool(self.rows),
            "get": lambda: iter(list(self.rows)) if self.rows or self.value is None and self.is_list else self.value,
            "update": lambda value: setattr(self, "value", value),
            "clear": lambda: (setattr(self, "value", None), self.rows.clear()),
            "appendList": lambda rows: self.rows.extend(rows),
        }[name]

        def called(*given):
            _State.calls += 1
            return done(*given)

        return called


def test_a_connection_takes_few_round_trips_to_its_state():
    columns = ["seq", "closes", "feeds", "head", "tail"]
    one = connections._Connection(None)
    one.began, one.pieces = _State(), _State()
    one.began.is_list, one.pieces.is_list = False, True
    _State.calls = 0
    first = list(one.handleInputRows((7,), iter([pd.DataFrame([(0, False, 1, b"a", b"b")], columns=columns)]), None))
    last = list(one.handleInputRows((7,), iter([pd.DataFrame([(0, True, 0, None, None)], columns=columns)]), None))
    assert [tuple(f.iloc[0])[-1] for f in (*first, *last)] == [b"a", b"b"]
    assert one.began.value is None and not one.pieces.rows
    assert _State.calls <= 5  # eleven before


def test_prompts_do_not_come_back_from_the_extractor():
    asked = pd.DataFrame({"raw": ["a", "b"], "prompt": ["p" * 2000] * 2})
    (found,) = extraction._answering(lambda batch: batch["prompt"].str.len().astype(str))(iter([asked]))
    assert list(found.columns) == ["raw", "ai_response", "error"] and list(found["ai_response"]) == ["2000"] * 2
