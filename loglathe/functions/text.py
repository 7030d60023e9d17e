"""Scalar text functions, ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def strip(col: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` removes the space character only)."""
    return F.btrim(col, F.lit(fixed.WHITESPACE))


def event_hash(raw: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(raw, 256)


def is_ip(col: Column) -> Column:
    """IPv4 or IPv6 by shape; octet ranges are not checked."""
    return col.rlike(fixed.IPV4) | col.rlike(fixed.IPV6)


def is_hostname(col: Column) -> Column:
    """A letter, then letters, digits and hyphens; no dots."""
    return col.rlike(fixed.HOSTNAME)


def is_printable(col: Column) -> Column:
    return ~col.rlike(fixed.NOT_PRINTABLE)


def none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` with null for no match."""
    return none_if_empty(F.regexp_extract(col, pattern, group))


def date_in_raw(ts: Column, raw: Column) -> Column:
    """True when the timestamp text shares a year, an ISO date or a month name with the raw line."""
    year = extract(ts, r"\p{Nd}{4}", 0)
    date = extract(ts, r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}", 0)
    found = F.coalesce(raw.contains(year), F.lit(False)) | F.coalesce(raw.contains(date), F.lit(False))
    for month in fixed.MONTHS:
        found = found | (ts.contains(month) & raw.contains(month))
    return F.when((ts != "") & (raw != ""), found).otherwise(F.lit(False))


# For x.xx5 exactly half-way between two cents the printed text depends on the stored binary value of the half:
# the value is looked up here, for each half in 0..1.
_HALF_CENT_ROUNDED = [round(float(f"{(2 * k + 1) / 200:.2f}") * 100) for k in range(100)]


def fixed2(col: Column) -> Column:
    """Two-decimal text of a double in 0..1, rounding the exact binary value (Java rounds the decimal text)."""
    cents = F.floor(col * 100).cast("int")
    half = (cents * 2 + 1) / F.lit(200.0)
    ties = F.array(*[F.lit(k) for k in _HALF_CENT_ROUNDED])
    rounded = (
        F.when(col >= 1, F.lit(100))
        .when(col < half, cents)
        .when(col > half, cents + 1)
        .otherwise(F.element_at(ties, cents + 1))
    )
    return F.concat(
        F.floor(rounded / 100).cast("string"), F.lit("."), F.lpad((rounded % 100).cast("string"), 2, "0")
    )


def iso_timestamp(ts: Column) -> Column:
    """ISO text in UTC, whatever the session time zone; the fraction is left out when it is zero."""
    seconds = F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1000000)
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    text = F.replace(utc.cast("string"), F.lit(" "), F.lit("T"))
    fraction = F.rpad(F.substring_index(text, ".", -1), 6, "0")
    whole = F.substring_index(text, ".", 1)
    return F.when(
        text.contains("."), F.concat(whole, F.lit("."), fraction, F.lit("+00:00"))
    ).otherwise(F.concat(whole, F.lit("+00:00")))


def decode(payload: Column, encoding: str = "utf-8", errors: str = "replace") -> Column:
    """Bytes to text.

    ``replace`` puts U+FFFD for bytes that are not UTF-8, ``strict`` fails the job.  Other encodings use
    ``decode``, which always fails on bytes it cannot map.
    """
    if errors not in ("replace", "strict"):
        raise ValueError(f"errors must be 'replace' or 'strict', got {errors!r}")
    if encoding.lower().replace("_", "-") not in ("utf-8", "utf8"):
        return F.decode(payload, encoding)
    text = payload.cast("string")
    if errors == "replace":
        return F.make_valid_utf8(text)
    return F.validate_utf8(text)
