"""From extractor answers to assembled events: parse the text, fill defaults, replace failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import answers, fixed
from ..functions.text import event_hash
from .once import evaluate_once


def failure_reason(answer: Column, ai_response: Column, error: Column) -> Column:
    """Why there is no usable answer, or null: the call failed, or the text holds no JSON object."""
    return F.when(error.isNotNull(), F.concat(F.lit(fixed.REASON_CALL_FAILED), error)).when(
        answer.isNull(),
        F.concat(
            F.lit(fixed.REASON_NOT_JSON),
            F.substring(F.coalesce(ai_response, F.lit("")), 1, fixed.NOT_JSON_CHARS),
        ),
    )


def _fallback_cells(reason: Column, now: Column) -> Column:
    constant = {
        "ts_source": answers.make_cell("string", "ingestion"),
        "event_ts": answers.make_cell("string", now),
        "category": answers.make_cell("string", "other"),
        "outcome": answers.make_cell("string", "unknown"),
        "message": answers.make_cell("string", F.concat(F.lit(fixed.PARSE_FAILURE_MESSAGE), reason)),
        "extras": answers.make_cell("object", "{}"),
        "confidence": answers.make_cell("number", "0.0"),
        "review_flag": answers.make_cell("boolean", "True"),
    }
    null = answers.make_cell("null", None)
    return F.struct(*[constant.get(key, null).alias(key) for key in answers.CELL_KEYS])


def assemble(rows: DataFrame, now: Column) -> DataFrame:
    """``raw, format_hint, ai_response, error`` to assembled events.

    Adds ``cells`` (kind and text of each answer key), ``extras``, ``event_hash`` and the first
    ``validation_issues``; other columns stay.  ``now`` is the ingestion time as text.
    """
    # Duplicate keys: the last one wins, as JSON readers usually do.
    rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    reason = F.col("_reason")
    parsed = rows.withColumn(
        "_answer", F.when(F.col("error").isNull(), answers.extract_json(F.col("ai_response")))
    ).withColumn("_reason", failure_reason(F.col("_answer"), F.col("ai_response"), F.col("error")))
    keys = answers.CELL_KEYS
    valued = parsed.withColumns({f"_v_{k}": answers.value(F.col("_answer"), k) for k in keys})
    typed = valued.withColumns({f"_t_{k}": F.schema_of_variant(f"_v_{k}") for k in keys})
    cells = F.struct(*[answers.cell(F.col(f"_v_{k}"), F.col(f"_t_{k}"), k).alias(k) for k in keys])
    return evaluate_once(
        typed,
        {
            "event_hash": event_hash(F.col("raw")),
            "validation_issues": F.when(
                reason.isNotNull(), F.array(F.concat(F.lit(fixed.PARSE_FAILURE_ISSUE), reason))
            ).otherwise(F.array().cast("array<string>")),
            "cells": F.when(reason.isNotNull(), _fallback_cells(reason, now)).otherwise(cells),
            "extras": answers.extras(F.col("_v_extras"), F.col("_t_extras")),
        },
        drop=(
            "_answer", "_reason", "ai_response", "error", *[f"_v_{k}" for k in keys], *[f"_t_{k}" for k in keys]
        ),
    )
