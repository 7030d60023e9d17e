"""Deterministic extraction rules for the documented line shapes, ``Column -> Column``.

Every rule takes the stripped line ``x``, the format label, and for JSON lines the parsed record ``j`` of
``json_record``.  Lines outside the known shapes get a low confidence and so go to review.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import extract, is_ip, none_if_empty

IP = r"\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}"
HEADER = r"^(?:<\p{Nd}{1,3}>)?[A-Z][a-z]{2}\s+\p{Nd}{1,2} \S+ \S+ "
PROCESS = HEADER + r"([A-Za-z0-9_\-]+)(?:\[\p{Nd}+\])?: "
BODY = HEADER + r"[A-Za-z0-9_\-]+(?:\[\p{Nd}+\])?: (?s:(.*))\z"
ISO_TIMESTAMP = (
    r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}[T ]\p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?"
    r"(?:Z|[+-]\p{Nd}{2}:?\p{Nd}{2})?"
)
RECORD_SCHEMA = (
    "eventName STRING, sourceIPAddress STRING, userIdentity STRUCT<userName: STRING>, "
    "requestParameters STRUCT<bucketName: STRING, key: STRING>"
)

FULL_MATCH_CONFIDENCE = 1.0
JSON_CONFIDENCE = 0.85
PARTIAL_CONFIDENCE = 0.6
NO_MATCH_CONFIDENCE = 0.3


def json_record(x: Column, label: Column) -> Column:
    """The audit-record fields of a JSON line, parsed once; null for other formats."""
    return F.when(label == "json", F.from_json(x, RECORD_SCHEMA))


def process(x: Column, label: Column) -> Column:
    """Program name of a syslog line."""
    return F.when(label == "syslog_rfc3164", F.regexp_extract(x, PROCESS, 1))


def body(x: Column, process: Column) -> Column:
    """Text after the program name; empty when there is none."""
    return F.when(process != "", F.regexp_extract(x, BODY, 1))


def firewall_verb(x: Column, label: Column) -> Column:
    """BLOCK or ALLOW of a firewall line, else null or empty."""
    return F.when(
        (label == "syslog_rfc3164") & x.contains("[UFW "), F.regexp_extract(x, r"\[UFW (BLOCK|ALLOW)\]", 1)
    )


def shape(label: Column, j: Column, process: Column, verb: Column) -> Column:
    """Line shape: ssh, sudo, fw, cef, json or other."""
    return (
        F.when(label == "cef", "cef")
        .when((label == "json") & j["eventName"].isNotNull(), "json")
        .when(verb != "", "fw")
        .when(process == "sshd", "ssh")
        .when(process == "sudo", "sudo")
        .otherwise("other")
    )


def src_ip(x: Column, j: Column) -> Column:
    """The literal tests only spare lines the regular expressions that cannot match."""
    after_from = F.coalesce(extract(x, rf" from ({IP})"), extract(x, rf" from user \S+ ({IP})"))
    return F.coalesce(
        F.when(x.contains("="), extract(x, rf"\b(?i:src)=({IP})")),
        F.when(x.contains(" from "), after_from),
        j["sourceIPAddress"],
    )


def dst_ip(x: Column) -> Column:
    return F.when(x.contains("="), extract(x, rf"\b(?i:dst)=({IP})"))


def actor_user(x: Column, j: Column, json_actor: bool = False) -> Column:
    rules = [
        F.when(x.contains(" for "), extract(x, r" for (?:invalid user )?(\S+) from ")),
        F.when(x.contains(" from user "), extract(x, r" from user (\S+)")),
        F.when(x.contains(" sudo: "), extract(x, r" sudo: (\S+)")),
        F.when(x.contains("suser="), extract(x, r"\bsuser=(\S+)")),
    ]
    if json_actor:
        rules.append(j["userIdentity"]["userName"])
    return F.coalesce(*rules)


def source_host(x: Column, label: Column) -> Column:
    """The token after the syslog time; an address is not a host name."""
    host = extract(
        x, r"^(?:<\p{Nd}{1,3}>)?[A-Z][a-z]{2}\s+\p{Nd}{1,2} \p{Nd}{2}:\p{Nd}{2}:\p{Nd}{2} (\S+)"
    )
    return F.when((label == "syslog_rfc3164") & ~is_ip(host), host)


def category(shape: Column) -> Column:
    return (
        F.when(shape == "ssh", "authentication")
        .when(shape == "sudo", "process")
        .when(shape.isin("fw", "cef"), "network")
        .when(shape == "json", "file")
        .otherwise("other")
    )


def action(shape: Column, j: Column, body: Column, verb: Column) -> Column:
    return (
        F.when(shape == "ssh", F.when(body.startswith("Disconnected"), "disconnect").otherwise("login"))
        .when(shape == "sudo", "sudo")
        .when(shape == "fw", F.lower(verb))
        .when(shape == "cef", "detected")
        .when(shape == "json", j["eventName"])
    )


def outcome(shape: Column, body: Column, verb: Column) -> Column:
    return (
        F.when((shape == "ssh") & body.startswith("Accepted"), "success")
        .when((shape == "ssh") & body.startswith("Failed"), "failure")
        .when((shape == "fw") & (verb == "BLOCK"), "failure")
        .when(shape.isin("sudo", "fw", "json"), "success")
        .otherwise("unknown")
    )


def target(shape: Column, j: Column) -> Column:
    """Bucket and key of an audit record; other shapes name no resource."""
    request = j["requestParameters"]
    path = F.nullif(F.concat_ws("/", request["bucketName"], request["key"]), F.lit(""))
    return F.when((shape == "json") & ~is_ip(path), path)


def cef_name(x: Column) -> Column:
    """Sixth header field; a pipe escaped with a backslash does not end a field."""
    return F.get(F.split(x, r"(?<!\\)\|"), 5)


def message(
    x: Column,
    shape: Column,
    j: Column,
    body: Column,
    verb: Column,
    src: Column,
    dst: Column,
    user: Column,
    target: Column,
) -> Column:
    sudo = F.concat(
        user,
        F.lit(" executed "),
        extract(x, r"COMMAND=(.*)\z"),
        F.lit(" as "),
        extract(x, r"\bUSER=(\S+)"),
    )
    firewall = F.concat(
        F.when(verb == "BLOCK", "UFW blocked ").otherwise("UFW allowed "),
        extract(x, r"\bPROTO=(\S+)"),
        F.lit(" from "),
        F.concat_ws(":", src, extract(x, r"\bSPT=(\p{Nd}+)")),
        F.lit(" to "),
        F.concat_ws(":", dst, extract(x, r"\bDPT=(\p{Nd}+)")),
    )
    cef = F.concat_ws(
        " ",
        cef_name(x),
        F.lit("detected"),
        F.concat(F.lit("from "), src),
        F.concat(F.lit("to "), dst),
    )
    record = F.concat_ws(
        " ", j["userIdentity"]["userName"], F.lit("accessed"), target, F.concat(F.lit("from "), src)
    )
    return (
        F.when(shape == "ssh", none_if_empty(body))
        .when(shape == "sudo", sudo)
        .when(shape == "fw", firewall)
        .when(shape == "cef", cef)
        .when(shape == "json", record)
    )


def event_ts(x: Column) -> Column:
    """First ISO date and time in the line; nothing is invented."""
    return F.replace(extract(x, ISO_TIMESTAMP, 0), F.lit(" "), F.lit("T"))


def confidence(shape: Column, message: Column, src: Column, dst: Column, user: Column, host: Column) -> Column:
    """1.0 when a template is filled, 0.85 for audit records, otherwise below the gate."""
    full = (
        ((shape == "ssh") & src.isNotNull() & user.isNotNull())
        | ((shape == "sudo") & message.isNotNull())
        | (shape.isin("fw", "cef") & message.isNotNull() & src.isNotNull() & dst.isNotNull())
    )
    some = F.coalesce(src, dst, user, host).isNotNull()
    return (
        F.when(full, F.lit(FULL_MATCH_CONFIDENCE))
        .when(shape == "json", F.lit(JSON_CONFIDENCE))
        .when(some, F.lit(PARTIAL_CONFIDENCE))
        .otherwise(F.lit(NO_MATCH_CONFIDENCE))
    )
