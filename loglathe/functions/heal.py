"""Healing and validation rules on answer cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .answers import Cell
from .text import is_hostname, is_ip, strip


def is_truthy(cell: Cell) -> Column:
    """Whether a dynamic value counts as set: not null, empty, zero or false."""
    kind, text = cell.kind, cell.text
    if kind is None:
        return F.coalesce(text != "", F.lit(False))
    return (
        F.when(kind == "null", False)
        .when(kind == "string", text != "")
        .when(kind == "boolean", text == "True")
        .when(kind == "number", text.try_cast("double") != 0)
        .when(kind == "object", text != "{}")
        .otherwise(text != "[]")
    )


def in_enum(cell: Cell, allowed: tuple[str, ...], default: str) -> Column:
    """Case-sensitive membership; anything else becomes the default."""
    return F.when(cell.is_kind("string") & cell.text.isin(*allowed), cell.text).otherwise(F.lit(default))


def confidence_value(cell: Cell) -> Column:
    """Number, numeric text or boolean to a double in 0..1; everything else, and not-a-number, is 0."""
    text, trimmed = cell.text, strip(cell.text)
    is_float = trimmed.rlike(fixed.FLOAT_TEXT)
    value = (
        F.when(cell.is_kind("number"), text.try_cast("double"))
        .when(cell.is_kind("boolean"), F.when(text == "True", 1.0).otherwise(0.0))
        .when(cell.is_kind("string") & is_float, F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("double"))
        .when(cell.is_kind("string") & trimmed.rlike(fixed.POSITIVE_INFINITY), F.lit(1.0))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))))


def below_gate(confidence: Column) -> Column:
    return confidence < fixed.CONFIDENCE_GATE


def ip_or_null(stripped: Column) -> Column:
    """Stripped text when it has the shape of an address."""
    return F.when(is_ip(stripped), stripped)


def src_ip_problem(text: Column) -> Column:
    """``hostname``, ``invalid`` or null for a stripped src_ip text."""
    return F.when((text != "") & ~is_ip(text), F.when(is_hostname(text), "hostname").otherwise("invalid"))


def src_ip_issue(problem: Column, text: Column, host_is_set: Column) -> Column:
    return (
        F.when((problem == "hostname") & ~host_is_set, _fill(fixed.ISSUE_HOST_MOVED, text))
        .when(problem == "hostname", _fill(fixed.ISSUE_HOST_DROPPED, text))
        .when(problem == "invalid", _fill(fixed.ISSUE_INVALID_IP, text))
    )


def hallucination_issue(ts: Column, now: Column) -> Column:
    return _fill(fixed.ISSUE_HALLUCINATION, ts, now)


def _fill(pattern: str, *values: Column) -> Column:
    parts: list[Column] = []
    for i, piece in enumerate(pattern.split("%s")):
        if i:
            parts.append(values[i - 1])
        parts.append(F.lit(piece))
    return F.concat(*parts)


def string_error(cell: Cell) -> Column | None:
    """Error text of a value that must be text or null; None when it cannot fail."""
    if cell.kind is None:
        return None
    return F.when(~cell.is_kind("string", "null"), F.lit(fixed.ERROR_STRING))


def text_or_null(cell: Cell) -> Column:
    return cell.text if cell.kind is None else F.when(cell.kind == "string", cell.text)


def bool_value(cell: Cell) -> Column:
    """Boolean, 0 or 1, or one of the usual words; null when it is none of these."""
    kind, text = cell.kind, cell.text
    number = text.try_cast("double")
    word = F.lower(text)
    return (
        F.when(kind == "boolean", text == "True")
        .when((kind == "number") & number.isin(0.0, 1.0), number == 1.0)
        .when((kind == "string") & word.isin(*fixed.TRUE_TEXTS), True)
        .when((kind == "string") & word.isin(*fixed.FALSE_TEXTS), False)
    )


def bool_error(cell: Cell) -> Column:
    """Error text of a value that ``bool_value`` cannot read."""
    kind, number = cell.kind, cell.text.try_cast("double")
    unreadable = (kind == "string") | ((kind == "number") & (number == F.floor(number)))
    return F.when(unreadable, F.lit(fixed.ERROR_BOOL_PARSING)).otherwise(F.lit(fixed.ERROR_BOOL))


def collect_issues(issues: list[Column]) -> Column:
    """Ordered array of the issues that are not null; most events have none."""
    none = F.coalesce(*issues).isNull()
    return F.when(none, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*issues)))
