"""Table-level jobs: each is one Spark plan over a whole dataset."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import event_hash, iso_timestamp, strip
from ..operators.assembly import assemble
from ..operators.detection import with_format
from ..operators.extraction import extract_with, with_rule_fields
from ..operators.healing import Answer, safe_parse
from ..operators.replay import replayed

Extractor = Callable[[pd.DataFrame], pd.Series]


def ingest_text(ingest_ts: str | Column | None) -> Column:
    """Ingestion time as ISO text: a given text or timestamp column, else the time of the query."""
    if ingest_ts is None:
        return iso_timestamp(F.current_timestamp())
    return F.lit(ingest_ts) if isinstance(ingest_ts, str) else iso_timestamp(ingest_ts)


def heal(rows: DataFrame, ingest_ts: str | Column | None = None) -> DataFrame:
    """A table of model answers (``raw, format_hint, ai_response, error``) to normalized events."""
    now = ingest_text(ingest_ts)
    return safe_parse(assemble(rows, now), now)


def parse(
    lines: DataFrame,
    extractor: Extractor | None = None,
    ingest_ts: str | Column | None = None,
    json_actor: bool = False,
    keep_error: bool = False,
    **extract_options,
) -> DataFrame:
    """Lines to normalized events: detect, extract, assemble, heal.

    Without an extractor the rules are used and the whole job is projections: no shuffle and no Python worker.
    ``keep_error`` adds ``call_error``, why the extractor's call for the line failed, or null.  Rows without ``raw`` are
    no lines and are left out.
    """
    if extractor is not None:
        answered = extract_with(lines.where(F.col("raw").isNotNull()), extractor, **extract_options)
        if keep_error:
            answered = answered.withColumn("call_error", F.col("error"))
        return heal(with_format(answered).drop("sample"), ingest_ts)

    def by_rules(rows: DataFrame) -> DataFrame:
        return _heal_rules(with_rule_fields(with_format(rows), json_actor), ingest_ts)

    if isinstance(ingest_ts, Column):
        return by_rules(lines)
    return replayed(lines, ("rules", json_actor, ingest_ts), by_rules)


def _heal_rules(found: DataFrame, ingest_ts: str | Column | None) -> DataFrame:
    events = found.withColumns(
        {
            "event_hash": event_hash(F.col("raw")),
            "validation_issues": F.array().cast("array<string>"),
            "extras": F.parse_json(F.lit("{}")),
        }
    )
    return safe_parse(events, ingest_text(ingest_ts), Answer.of_rules(F.col("found")))


def parse_batch(
    lines: DataFrame, hints: DataFrame, ingest_ts: str | Column | None = None, key: str = "line_id"
) -> DataFrame:
    """Lines paired with given hints (``key, format``), one to one.

    The pairing is checked inside the plan: a full join keeps unmatched keys, and each of them fails the job, as does a
    key that either side has twice.
    """
    paired = lines.join(hints.select(key, F.col("format").alias("format_hint")), key, "full")
    check = F.when(
        F.col("raw").isNull() | F.col("format_hint").isNull(),
        F.raise_error(F.concat(F.lit("parse_batch: lines and hints must pair; unpaired key "), F.col(key))),
    ).otherwise(F.col("raw"))
    check = F.when(
        F.count("*").over(Window.partitionBy(key)) > 1,
        F.raise_error(F.concat(F.lit("parse_batch: lines and hints must pair; repeated key "), F.col(key))),
    ).otherwise(check)
    checked = paired.withColumn("raw", check)
    return _heal_rules(with_rule_fields(checked.withColumn("sample", strip(F.col("raw")))), ingest_ts)
