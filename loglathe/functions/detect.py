"""Format detection: each format is one predicate on the stripped line, the label is one CASE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed
from .text import fixed2, is_printable


def is_evtx(x: Column) -> Column:
    """Windows event namespace, or at least two of the six markers, anywhere in the text."""
    markers = reduce(lambda a, b: a + b, [x.contains(m).cast("int") for m in fixed.EVTX_MARKERS])
    return x.contains(fixed.EVTX_NAMESPACE) | (markers >= 2)


def is_cef(x: Column) -> Column:
    return x.rlike(fixed.CEF_START)


def has_syslog_header(x: Column) -> Column:
    return x.rlike(fixed.SYSLOG_HEADER)


def has_syslog_priority(x: Column) -> Column:
    return x.rlike(fixed.SYSLOG_PRIORITY)


def is_syslog(x: Column) -> Column:
    return has_syslog_header(x) | has_syslog_priority(x)


def is_json(x: Column) -> Column:
    return x.rlike(fixed.JSON_START)


def is_xml(x: Column) -> Column:
    return x.rlike(fixed.XML_DECLARATION) | (x.contains("</") & x.rlike(fixed.XML_TAG)) | x.endswith("/>")


def is_csv(x: Column) -> Column:
    return x.rlike(fixed.CSV_LINE)


def is_kv(x: Column) -> Column:
    return x.contains("=") & x.rlike(fixed.KV_TRIPLE)


def is_plaintext(x: Column) -> Column:
    return (x != "") & is_printable(x)


def format_label(x: Column) -> Column:
    """First matching format wins."""
    return (
        F.when(is_evtx(x), "evtx_xml")
        .when(is_cef(x), "cef")
        .when(is_syslog(x), "syslog_rfc3164")
        .when(is_json(x), "json")
        .when(is_xml(x), "xml")
        .when(is_csv(x), "csv")
        .when(is_kv(x), "kv")
        .when(is_plaintext(x), "plaintext")
        .otherwise("unknown")
    )


def _by_label(label: Column, table: dict) -> Column:
    case = None
    for key, value in table.items():
        case = F.when(label == key, F.lit(value)) if case is None else case.when(label == key, F.lit(value))
    return case


def format_confidence(label: Column, x: Column) -> Column:
    """Confidence of a label; a syslog line with a priority but no header is less certain."""
    return F.when(
        (label == "syslog_rfc3164") & ~has_syslog_header(x), F.lit(fixed.SYSLOG_PRIORITY_ONLY_CONFIDENCE)
    ).otherwise(_by_label(label, fixed.FORMAT_CONFIDENCE))


def guidance(label: Column) -> Column:
    return _by_label(label, fixed.FORMAT_GUIDANCE)


def raw_sample(x: Column) -> Column:
    return F.substring(x, 1, fixed.SAMPLE_CHARS)


def prompt_context(hint: Column) -> Column:
    """Four-line text describing a hint struct to an extractor."""
    return F.concat_ws(
        "\n",
        F.lit(fixed.HINT_HEADER),
        F.concat(F.lit(fixed.HINT_FORMAT), hint["hint"]),
        F.concat(F.lit(fixed.HINT_CONFIDENCE), fixed2(hint["confidence"])),
        F.concat(F.lit(fixed.HINT_SAMPLE), raw_sample(hint["raw_sample"])),
    )
