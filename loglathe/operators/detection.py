"""Format detection over tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import detect as d
from ..functions.text import strip


def with_format(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``sample`` (stripped line) and ``format_hint`` (label).  A projection: no shuffle, no Python.

    The strip is its own projection, so the predicates share one stripped value.
    """
    stripped = lines.where(F.col(raw).isNotNull()).withColumn("sample", strip(F.col(raw)))
    return stripped.withColumn("format_hint", d.format_label(F.col("sample")))


def detect(lines: DataFrame, raw: str = "raw", column: str = "hint") -> DataFrame:
    """Add a struct ``format, confidence, hint, raw_sample`` for every line."""
    x, label = F.col("sample"), F.col("format_hint")
    hint = F.struct(
        label.alias("format"),
        d.format_confidence(label, x).alias("confidence"),
        d.guidance(label).alias("hint"),
        d.raw_sample(x).alias("raw_sample"),
    )
    return with_format(lines, raw).withColumn(column, hint).drop("sample", "format_hint")


def profile_formats(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines per source and format; without a ``source`` column, per format."""
    keys = ["source", "format_hint"] if "source" in lines.columns else ["format_hint"]
    return with_format(lines, raw).groupBy(*keys).agg(F.count("*").alias("lines"))
