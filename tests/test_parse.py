import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loglathe.operators.assembly import assemble
from loglathe.operators.extraction import build_prompt, extract_rules, extract_with
from loglathe.operators.detection import detect, with_format
from loglathe.plans.jobs import heal, parse, parse_batch

from .conftest import NOW

BODY1 = "Accepted password for deploy from 10.10.1.50 port 54231 ssh2"
BODY2 = "Failed password for root from 203.0.113.99 port 41512 ssh2"
GOLDENS = [
    (
        f"May  9 14:23:01 prod-server-01 sshd[22341]: {BODY1}",
        dict(format_hint="syslog_rfc3164", source_host="prod-server-01", category="authentication", action="login",
             outcome="success", actor_user="deploy", src_ip="10.10.1.50", message=BODY1, confidence=1.0),
    ),
    (
        f"May  9 14:23:05 prod-server-01 sshd[22342]: {BODY2}",
        dict(format_hint="syslog_rfc3164", source_host="prod-server-01", category="authentication", action="login",
             outcome="failure", actor_user="root", src_ip="203.0.113.99", message=BODY2, confidence=1.0),
    ),
    (
        "May  9 14:23:10 prod-server-01 sudo: alice : TTY=pts/1 ; PWD=/home/alice ; USER=root ; "
        "COMMAND=/usr/bin/apt-get update",
        dict(format_hint="syslog_rfc3164", source_host="prod-server-01", category="process", action="sudo",
             outcome="success", actor_user="alice", message="alice executed /usr/bin/apt-get update as root",
             confidence=1.0),
    ),
    (
        "May  9 14:23:15 fw-01 kernel: [UFW BLOCK] IN=eth0 OUT= SRC=45.33.32.156 DST=10.10.1.1 PROTO=TCP SPT=80 "
        "DPT=22 FLAGS=SYN",
        dict(format_hint="syslog_rfc3164", source_host="fw-01", category="network", action="block", outcome="failure",
             src_ip="45.33.32.156", dst_ip="10.10.1.1",
             message="UFW blocked TCP from 45.33.32.156:80 to 10.10.1.1:22", confidence=1.0),
    ),
    (
        "CEF:0|Suricata|ids|6.0|2001219|ET MALWARE Win32/Metasploit CnC Beacon|8|src=203.0.113.99 spt=4444 "
        "dst=10.10.1.22 dpt=443 proto=TCP",
        dict(format_hint="cef", category="network", action="detected", outcome="unknown", src_ip="203.0.113.99",
             dst_ip="10.10.1.22", confidence=1.0,
             message="ET MALWARE Win32/Metasploit CnC Beacon detected from 203.0.113.99 to 10.10.1.22"),
    ),
    (
        '{"timestamp":"2026-05-09T14:23:35Z","eventName":"GetObject","userIdentity":{"userName":"alice"},'
        '"sourceIPAddress":"10.10.1.50","requestParameters":{"bucketName":"prod-data","key":"secrets.env"}}',
        dict(format_hint="json", category="file", action="GetObject", outcome="success", src_ip="10.10.1.50",
             target="prod-data/secrets.env", event_ts="2026-05-09T14:23:35Z", ts_source="original", confidence=0.85,
             message="alice accessed prod-data/secrets.env from 10.10.1.50"),
    ),
]
DEFAULTS = dict(
    event_ts=NOW, ts_source="ingestion", source_host=None, actor_user=None, src_ip=None, dst_ip=None, target=None,
    extras={}, review_flag=False, validation_issues=[],
)


def as_dicts(events):
    out = []
    for row in events.withColumn("extras", F.to_json("extras")).orderBy("line_id").collect():
        event = row.asDict()
        event["extras"] = json.loads(event["extras"])
        out.append(event)
    return out


def expected(i, raw, fields):
    return {**DEFAULTS, "line_id": i, "raw": raw, "event_hash": hashlib.sha256(raw.encode()).hexdigest(), **fields}


@pytest.mark.parametrize("through_json", [False, True])
def test_goldens(lines, through_json):
    df = lines([g[0] for g in GOLDENS])
    events = heal(extract_rules(df), NOW) if through_json else parse(df, ingest_ts=NOW)
    for i, (event, (raw, fields)) in enumerate(zip(as_dicts(events), GOLDENS)):
        assert event == expected(i, raw, fields)


def test_rule_one_liners(lines):
    head = "May  9 14:23:01 prod-server-01 sshd[22341]: "
    events = as_dicts(parse(lines([
        head + "Failed password for invalid user admin from 10.0.0.1 port 1 ssh2",
        head + "Disconnected from user deploy 10.10.1.50 port 54231",
        "May  9 14:23:05 prod-server-01 sshd: Failed password for root from 203.0.113.99",
        "May  9 14:23:01 10.0.0.9 app: hello",
        "CEF:0|short",
    ]), ingest_ts=NOW))
    assert (events[0]["actor_user"], events[0]["src_ip"], events[0]["outcome"]) == ("admin", "10.0.0.1", "failure")
    assert (events[1]["actor_user"], events[1]["src_ip"], events[1]["action"]) == ("deploy", "10.10.1.50", "disconnect")
    assert (events[2]["src_ip"], events[2]["category"], events[2]["outcome"]) == ("203.0.113.99", "authentication", "failure")
    assert events[3]["source_host"] is None and events[3]["review_flag"]
    assert events[4]["review_flag"]


def test_json_actor_option(lines):
    assert as_dicts(parse(lines([GOLDENS[5][0]]), ingest_ts=NOW, json_actor=True))[0]["actor_user"] == "alice"


RAW = "2026-05-09 port 12026 something"


@pytest.fixture
def answer_events(spark):
    def run(answers, raw=RAW, label="plaintext", error=None):
        rows = [(i, raw, label, a, error) for i, a in enumerate(answers)]
        schema = "line_id BIGINT, raw STRING, format_hint STRING, ai_response STRING, error STRING"
        return as_dicts(heal(spark.createDataFrame(rows, schema), NOW))

    return run


def answer(**fields):
    return json.dumps({"confidence": 0.9, **fields})


def test_src_ip_fix(answer_events):
    got = answer_events([
        answer(src_ip="web-01"), answer(src_ip="web-01", source_host="h"), answer(src_ip="host.example.com"),
        answer(src_ip="999.9.9.9"), answer(src_ip=" 10.0.0.1 "), answer(src_ip="  "), answer(dst_ip="web-01"),
    ])
    issues = [
        ["IP/Hostname Fix: src_ip 'web-01' was a hostname — moved to source_host, src_ip set to null."],
        ["IP/Hostname Fix: src_ip 'web-01' was a hostname — set to null (source_host already populated)."],
        ["Invalid IP: src_ip 'host.example.com' is not a valid IP address — set to null."],
        [], [], [], [],
    ]
    assert [e["validation_issues"] for e in got] == issues
    assert [e["src_ip"] for e in got] == [None, None, None, "999.9.9.9", "10.0.0.1", None, None]
    assert [e["source_host"] for e in got][:3] == ["web-01", "h", None]
    assert not any(e["review_flag"] for e in got) and got[6]["dst_ip"] is None


def test_time(answer_events):
    got = answer_events([
        answer(event_ts="2025-01-01T00:00:00Z"), answer(event_ts="2026-05-09T14:00:00Z", ts_source=None),
        answer(event_ts="2026-05-09T14:00:00Z"), answer(event_ts=None), answer(event_ts=1202600000),
        answer(event_ts="May 9"), answer(event_ts=0), answer(event_ts=True),
    ])
    assert [(e["event_ts"], e["ts_source"]) for e in got][:4] == [
        (NOW, "ingestion"), ("2026-05-09T14:00:00Z", "original"), ("2026-05-09T14:00:00Z", "ingestion"), (NOW, "ingestion"),
    ]
    issue = f"Hallucination Fix: event_ts '%s' not found in raw log — overridden with ingestion time '{NOW}'."
    assert got[0]["validation_issues"] == [issue % "2025-01-01T00:00:00Z"] and got[0]["review_flag"]
    assert got[4]["message"] == "[VALIDATION FAILURE] event_ts: Input should be a valid string"
    assert got[5]["validation_issues"] == [issue % "May 9"]
    assert got[6]["event_ts"] == NOW and not got[6]["review_flag"]
    assert got[7]["validation_issues"] == [issue % "True"]
    syslog = answer_events([answer(event_ts="2025-01-01T00:00:00Z")], raw="May  9 14:23:01 h x", label="syslog_rfc3164")
    assert (syslog[0]["event_ts"], syslog[0]["review_flag"], syslog[0]["validation_issues"]) == (NOW, False, [])


def test_enums_and_confidence(answer_events):
    values = [1.5, -1, "0.9", "90%", None, True, 0.7, "NaN", "inf", "1.0d", " 1_0 ", [1], "0x1p3", ".8", "-inf"]
    got = answer_events([answer(confidence=v, category="Authentication", outcome=[]) for v in values])
    assert [e["confidence"] for e in got] == [1, 0, 0.9, 0, 0, 1, 0.7, 0, 1, 0, 1, 0, 0, 0.8, 0]
    assert [e["review_flag"] for e in got] == [e["confidence"] < 0.7 for e in got]
    assert {(e["category"], e["outcome"]) for e in got} == {("other", "unknown")}
    assert answer_events(['{"category":"network"}'])[0]["confidence"] == 0.0


def test_quarantine_and_flags(answer_events):
    got = answer_events([
        answer(source_host=5, target=["x"]), answer(review_flag="yes"), answer(review_flag=None), answer(review_flag=1),
        answer(review_flag="maybe"), answer(review_flag=2), answer(review_flag=0.5), answer(review_flag="Off"),
        answer(extras=[1]), answer(extras={"b": 1, "a": {"c": None}}, unknown=3), answer(source_host=0, src_ip="web-01"),
    ])
    text = "Input should be a valid string"
    assert got[0]["validation_issues"] == [f"source_host: {text}", f"target: {text}"]
    assert got[0]["message"] == f"[VALIDATION FAILURE] source_host: {text}; target: {text}"
    assert (got[0]["format_hint"], got[0]["confidence"], got[0]["review_flag"], got[0]["category"]) == (None, 0.0, True, "other")
    assert got[1]["review_flag"] and got[3]["review_flag"] and not got[7]["review_flag"]
    flag = "review_flag: Input should be a valid boolean"
    assert [got[i]["validation_issues"] for i in (2, 4, 5, 6)] == [
        [flag], [flag + ", unable to interpret input"], [flag + ", unable to interpret input"], [flag],
    ]
    assert got[8]["extras"] == {} and got[9]["extras"] == {"b": 1, "a": {"c": None}}
    assert got[10]["source_host"] == "web-01"


OK = '{"confidence":0.9,"action":"x"}'


def test_answer_text(answer_events):
    got = answer_events([
        OK, f"```json\n{OK}\n```", f"Sure: {OK}. Done", f"{OK} {OK}", "null", "[1]", "", f"　{OK}　", '{"a":NaN}',
        '{"action":"a","confidence":0.1,"action":"b","confidence":0.9}', OK + "],[2", OK + ",1],[2", "5", "{'action':'x'}",
    ])
    good = [i for i, e in enumerate(got) if not (e["message"] or "").startswith("[PARSE FAILURE]")]
    # The two forms that close an array early still hold one object between the first and the last brace.
    assert good == [0, 1, 2, 7, 9, 10, 11]
    assert (got[9]["action"], got[9]["confidence"]) == ("b", 0.9)
    assert got[4]["message"] == "[PARSE FAILURE] AI returned non-JSON response: null"
    assert got[4]["validation_issues"] == [
        "Parse failure: AI returned non-JSON response: null",
        f"Hallucination Fix: event_ts '{NOW}' not found in raw log — overridden with ingestion time '{NOW}'.",
    ][: 1]
    long = answer_events(["é" * 200], raw="no year here")[0]
    assert long["message"].endswith(": " + "é" * 120) and len(long["validation_issues"]) == 2


def test_failed_call(answer_events):
    event = answer_events([None], raw="May  9 14:23:01 h x", label="syslog_rfc3164", error="timeout")[0]
    assert event["message"] == "[PARSE FAILURE] Ollama call failed: timeout"
    assert event["validation_issues"] == ["Parse failure: Ollama call failed: timeout"]
    assert (event["confidence"], event["review_flag"], event["format_hint"]) == (0.0, True, "syslog_rfc3164")


def test_filter_after_parse_plans(lines, spark):
    """Filters on events and answers must not copy the whole extraction into themselves."""
    assert parse(lines([g[0] for g in GOLDENS]), ingest_ts=NOW).where("message LIKE '%UFW%' AND NOT review_flag").count() == 1
    rows = spark.createDataFrame([(0, RAW, "plaintext", OK, None)], "line_id BIGINT, raw STRING, format_hint STRING, ai_response STRING, error STRING")
    assert heal(rows, NOW).where("message IS NULL AND confidence > 0.5").count() == 1
    assert assemble(rows, F.lit(NOW)).where("cells.action.text = 'x'").count() == 1


def extractor(batch: pd.DataFrame) -> pd.Series:
    if (batch["raw"] == "bad").any():
        raise RuntimeError("no answer")
    return '{"confidence":0.9,"message":"' + batch["prompt"].str.len().astype(str) + '"}'


@pytest.mark.parametrize("once", [True, False])
def test_user_extractor(lines, once):
    df = lines(["good", "bad", "good", "other"])
    got = {r["line_id"]: r for r in extract_with(df, extractor, once_per_line=once, parallelism=2).collect()}
    assert len(got) == 4 and got[0]["ai_response"] == got[2]["ai_response"] is not None
    assert (got[1]["ai_response"], got[1]["error"]) == (None, "no answer")
    events = as_dicts(parse(df, extractor, NOW, once_per_line=once))
    assert [e["review_flag"] for e in events] == [False, True, False, False]


def test_prompt_holds_line_and_hint(lines):
    text = build_prompt(detect(lines(["a,b,c,d"])), "SYSTEM").first()["prompt"]
    assert text.startswith("SYSTEM\n\nUser: [PRE-PROCESSOR HINT]\n")
    assert text.endswith("\n\nParse the following log line and return the JSON schema:\n\na,b,c,d")


def test_parse_batch(lines, spark):
    df = lines([g[0] for g in GOLDENS])
    hints = detect(df).select("line_id", "hint.format")
    assert as_dicts(parse_batch(df, hints, NOW)) == as_dicts(parse(df, ingest_ts=NOW))
    with pytest.raises(Exception, match="must pair"):
        parse_batch(df, hints.where("line_id > 0"), NOW).collect()


def test_null_lines_are_dropped(lines):
    assert with_format(lines(["x", None])).count() == 1


def test_default_ingest_time_is_utc_now(lines):
    from datetime import datetime, timedelta, timezone

    text = parse(lines(["x"])).first()["event_ts"]
    assert abs(datetime.now(timezone.utc) - datetime.fromisoformat(text)) < timedelta(minutes=5)
