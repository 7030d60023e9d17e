"""Lines from object texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.answers import is_one_value
from ..functions.text import strip

# Line boundaries of Unicode text; carriage return plus line feed is one boundary.
LINE_BREAKS = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]"


def envelope_records(text: Column) -> Column:
    """Records of a ``{"Records": [...]}`` text as compact JSON texts; null when it is no such envelope.

    A text with anything after the first value, such as several envelopes, is none: its lines are kept instead.  Records
    that are texts keep their quotes, a null is ``null``; objects keep the order of their keys.
    """
    trimmed = strip(text)
    plain = F.from_json(trimmed, "Records ARRAY<STRING>")["Records"]
    typed = F.from_json(trimmed, "Records ARRAY<VARIANT>")["Records"]

    def shown(record: Column, value: Column) -> Column:
        return (
            F.when(value.isNull() | F.is_variant_null(value), "null")
            .when(F.schema_of_variant(value) == "STRING", F.to_json(value))
            .otherwise(record)
        )

    records = F.zip_with(plain, typed, shown)
    return F.when(trimmed.startswith("{") & trimmed.contains('"Records"') & is_one_value(trimmed), records)


def unwrap_records(objects: DataFrame, text: str = "text") -> DataFrame:
    """One row per record of each envelope object: ``pos`` and ``raw``; other objects give no row."""
    kept = [c for c in objects.columns if c != text]
    return objects.select(
        *kept, F.posexplode(envelope_records(F.col(text))).alias("pos", "raw")
    ).where(F.col("raw").isNotNull())


def split_text(objects: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of each object that is not blank: ``pos`` and ``raw``."""
    kept = [c for c in objects.columns if c != text]
    lines = objects.select(*kept, F.posexplode(F.split(F.col(text), LINE_BREAKS)).alias("pos", "raw"))
    return lines.where(strip(F.col("raw")) != "")


def object_lines(objects: DataFrame, text: str = "text") -> DataFrame:
    """Lines of each object: its records when it is a filled envelope, else its text lines."""
    kept = [c for c in objects.columns if c != text]
    records = F.col("_records")
    pieces = F.when(F.size(records) > 0, records).otherwise(F.split(F.col(text), LINE_BREAKS))
    parsed = objects.withColumn("_records", envelope_records(F.col(text)))
    lines = parsed.select(*kept, F.posexplode(pieces).alias("pos", "raw"))
    return lines.where(strip(F.col("raw")) != "")
