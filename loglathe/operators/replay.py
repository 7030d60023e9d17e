"""Long chains of projections that are written down once and applied again to each micro-batch."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

from pyspark import SparkContext
from pyspark.sql import DataFrame

#: Chains that are kept; the oldest go.
MAX_KEPT = 64

_STEPS = ("drop", "select", "where", "withColumn", "withColumns")
_kept: OrderedDict[Hashable, tuple[Any, Any]] = OrderedDict()


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returned for this key before: columns, which belong to a JVM and to no session or table."""
    gateway = SparkContext._gateway
    found = _kept.get(key)
    if found is None or found[0] is not gateway:
        found = _kept[key] = gateway, make()
        while len(_kept) > MAX_KEPT:
            _kept.popitem(last=False)
    return found[1]


class _Recorder:
    """A table that notes the steps applied to it, each of which gives such a table again."""

    def __init__(self, df: DataFrame, steps: tuple = ()) -> None:
        self.df, self.steps = df, steps

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def __getattr__(self, name: str) -> Callable[..., _Recorder]:
        if name not in _STEPS:
            raise AttributeError(f"{name} can't be replayed")

        def step(*args, **kwargs) -> _Recorder:
            return _Recorder(getattr(self.df, name)(*args, **kwargs), (*self.steps, (name, args, kwargs)))

        return step


def replayed(df: DataFrame, key: Hashable, chain: Callable[[Any], Any]) -> DataFrame:
    """``chain(df)``, a chain of projections and filters that depends on ``key`` and the names of the columns alone.

    To build the columns of such a chain takes thousands of calls from Python into the JVM, more time than a small
    micro-batch needs for its lines.  Columns are not bound to a table, so they are built once and applied to each.
    """
    key = (key, tuple(df.columns))
    first: list[DataFrame] = []

    def make() -> tuple:
        done = chain(_Recorder(df))
        first.append(done.df)
        return done.steps

    steps = kept(key, make)
    if first:
        return first[0]
    for name, args, kwargs in steps:
        df = getattr(df, name)(*args, **kwargs)
    return df
