"""Healing and validation of assembled events, one chain of projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import answers, fixed, heal as h
from ..functions.answers import Cell
from ..functions.text import date_in_raw, strip
from ..schema import EVENT_COLUMNS

_TEXT_FIELDS = ("source_host", "action", "actor_user", "target", "message")


@dataclass(frozen=True)
class Answer:
    """Where healing finds the values of an answer.

    ``confidence`` is in 0..1.  ``review_flag`` is None for an answer that never asks for review.
    """

    cells: dict[str, Cell]
    confidence: Column
    review_flag: Cell | None = None

    @classmethod
    def of_cells(cls, cells: Column) -> Answer:
        """Values of any kind, from the ``cells`` of an assembled event."""
        by_key = {key: Cell.of(cells[key]) for key in answers.CELL_KEYS}
        return cls(by_key, h.confidence_value(by_key["confidence"]), by_key["review_flag"])

    @classmethod
    def of_rules(cls, found: Column) -> Answer:
        """Fields of the rule extractor: text or null, so no value has a wrong type."""
        text = {key: Cell(found[key]) for key in answers.CELL_KEYS if key not in _NOT_FROM_RULES}
        return cls({**text, "ts_source": Cell(F.lit(None).cast("string"))}, found["confidence"])


_NOT_FROM_RULES = ("ts_source", "extras", "confidence", "review_flag")


def time_case(answer: Answer, raw: Column, format_hint: Column) -> Column:
    """``missing``, ``invented``, ``unchecked`` (no raw line) or ``verified``."""
    ts = answer.cells["event_ts"]
    return (
        F.when(format_hint == "syslog_rfc3164", "missing")
        .when(~h.is_truthy(ts), "missing")
        .when(raw == "", "unchecked")
        .when(date_in_raw(ts.text, raw), "verified")
        .otherwise("invented")
    )


def heal_fields(events: DataFrame, answer: Answer, now: Column) -> DataFrame:
    """Cross-field fixes and type checks as helper columns.

    ``_time_case``, ``_src_problem``, ``_host_text``, ``_confidence``, ``_forced`` (review regardless of the answer),
    ``_issues`` (what was healed) and ``_errors`` (values of a wrong type), both in order.
    """
    cells, raw = answer.cells, F.col("raw")
    ts, host = cells["event_ts"], cells["source_host"]
    case, problem, src = F.col("_time_case"), F.col("_src_problem"), F.col("_src_text")
    step = events.withColumns(
        {
            "_src_text": strip(cells["src_ip"].text),
            "_time_case": time_case(answer, raw, F.col("format_hint")),
            "_confidence": answer.confidence,
            "_host_set": h.is_truthy(host),
            **({} if answer.review_flag is None else {"_flag": h.bool_value(answer.review_flag)}),
        }
    ).withColumn("_src_problem", h.src_ip_problem(src))
    moved = F.coalesce((problem == "hostname") & ~F.col("_host_set"), F.lit(False))
    forced = (case == "invented") | h.below_gate(F.col("_confidence"))
    step = step.withColumns(
        {
            "_forced": forced,
            "_host_text": F.when(moved, src).otherwise(h.text_or_null(host)),
            "_src_issue": h.src_ip_issue(problem, src, F.col("_host_set")),
            "_ts_issue": F.when(case == "invented", h.hallucination_issue(ts.text, now)),
            "_ts_source": F.when(case == "unchecked", h.text_or_null(cells["ts_source"]))
            .when((case == "verified") & F.coalesce(cells["ts_source"].text != "ingestion", F.lit(True)), "original")
            .otherwise("ingestion"),
        }
    )
    if ts.kind is None:
        errors = {}
    else:
        source_ok = F.coalesce(F.col("_ts_source").isin("original", "ingestion"), F.lit(False))
        errors = {
            "event_ts": F.when(case.isin("verified", "unchecked"), h.string_error(ts)),
            "ts_source": F.when(~source_ok, F.lit(fixed.ERROR_TS_SOURCE)),
            "source_host": F.when(~moved, h.string_error(host)),
            **{k: h.string_error(cells[k]) for k in _TEXT_FIELDS if k != "source_host"},
            "review_flag": F.when(~F.col("_forced") & F.col("_flag").isNull(), h.bool_error(answer.review_flag)),
        }
    labelled = {f"_e_{k}": F.concat(F.lit(f"{k}: "), e) for k, e in errors.items()}
    step = step.withColumns(labelled) if labelled else step
    no_errors = F.array().cast("array<string>")
    return step.withColumns(
        {
            "_errors": h.collect_issues([F.col(c) for c in labelled]) if labelled else no_errors,
            "_issues": F.concat("validation_issues", h.collect_issues([F.col("_src_issue"), F.col("_ts_issue")])),
        }
    )


def safe_parse(events: DataFrame, now: Column, answer: Answer | None = None) -> DataFrame:
    """Assembled events to normalized events; an event with a type error is reset and sent to review.

    Columns that are not part of the event (lineage) are kept in front.
    """
    answer = answer or Answer.of_cells(F.col("cells"))
    cells = answer.cells
    healed = heal_fields(events, answer, now)
    checked = cells["event_ts"].kind is not None
    if checked:
        healed = healed.withColumn("_ok", F.size("_errors") == 0)

    def ok(value: Column, reset: Column | None = None) -> Column:
        if not checked:
            return value
        return F.when(F.col("_ok"), value) if reset is None else F.when(F.col("_ok"), value).otherwise(reset)

    case = F.col("_time_case")
    flagged = F.col("_forced") if answer.review_flag is None else F.col("_forced") | F.coalesce("_flag", F.lit(True))
    failure = F.concat(F.lit(fixed.VALIDATION_FAILURE), F.array_join("_errors", "; "))
    columns = {
        "event_hash": F.col("event_hash"),
        "event_ts": ok(F.when(case.isin("verified", "unchecked"), cells["event_ts"].text).otherwise(now), now),
        "ts_source": ok(F.col("_ts_source"), F.lit("ingestion")),
        "source_host": ok(F.col("_host_text")),
        "category": ok(h.in_enum(cells["category"], fixed.CATEGORIES, "other"), F.lit("other")),
        "outcome": ok(h.in_enum(cells["outcome"], fixed.OUTCOMES, "unknown"), F.lit("unknown")),
        "src_ip": ok(F.when(F.col("_src_problem").isNull(), F.nullif(F.col("_src_text"), F.lit("")))),
        "dst_ip": ok(h.ip_or_null(strip(cells["dst_ip"].text))),
        "message": ok(h.text_or_null(cells["message"]), failure),
        "raw": F.col("raw"),
        "extras": ok(F.col("extras"), F.parse_json(F.lit("{}"))),
        "confidence": ok(F.col("_confidence"), F.lit(0.0)),
        "review_flag": ok(flagged, F.lit(True)),
        "validation_issues": ok(F.col("_issues"), F.col("_errors")),
        "format_hint": ok(F.col("format_hint")),
    }
    for key in ("action", "actor_user", "target"):
        columns[key] = ok(h.text_or_null(cells[key]))
    lineage = [n for n in events.columns if n not in {*EVENT_COLUMNS, "cells", "found"}]
    return healed.select(*lineage, *[columns[name].alias(name) for name in EVENT_COLUMNS])


def is_confident(review_flag: Column) -> Column:
    return ~review_flag
