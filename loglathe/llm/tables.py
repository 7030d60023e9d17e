"""Intermediate tables of the operators, written where all executors can read them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.operators.storage import delete_path, work_path


class Tables:
    """Parquet tables of one operator call below ``spark.checkpoint.dir``; a lost executor loses none of them.

    Tables that only earlier steps needed are dropped by name.  Those that the returned DataFrame reads have to stay.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.name = name
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = work_path(self.spark, self.name)
        df.write.parquet(path)
        table = self.spark.read.parquet(path)
        self.paths[id(table)] = path
        self.paths[path] = table  # type: ignore[index]  # keeps the id from being given to another frame
        return table

    def drop(self, table: DataFrame) -> None:
        path = self.paths.pop(id(table))
        self.paths.pop(path)
        delete_path(self.spark, path)


def set_apart(docs: DataFrame, used: Iterable[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but the ``used`` ones as one struct, so that an operator's own columns can't clash with
    them, and a function that gives a result the columns of ``docs`` again, and after them the ``new`` ones."""
    used = set(used)
    others = [c for c in docs.columns if c not in used]
    if not others:
        return docs, lambda done, *new: done.select(*[F.col(f"`{c}`") for c in docs.columns], *new)
    name = "apart"
    while name in used:
        name += "_"
    packed = docs.select(
        *[c for c in docs.columns if c in used], F.struct(*[F.col(f"`{c}`") for c in others]).alias(name)
    )

    def back(done: DataFrame, *new: str) -> DataFrame:
        given = [F.col(name).getField(c).alias(c) if c in others else F.col(c) for c in docs.columns]
        return done.select(*given, *new)

    return packed, back
