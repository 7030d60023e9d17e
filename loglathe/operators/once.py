"""A step that is computed once per row, whatever follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluate_once(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """``withColumns`` whose expressions are neither copied into later filters nor repeated by later columns.

    The optimizer pushes a filter below a projection by copying the projected expressions into it.  Over a chain
    of projections that refer to each other many times, the copies grow beyond what can be planned.  The rows of
    a generator are not copied, so the values pass through one that gives one row.
    """
    kept = [c for c in df.columns if c not in columns and c not in drop]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.explode(F.array(row)).alias("_row")).select(*kept, "_row.*")
