import random
import re

import pytest
from pyspark.sql import functions as F

from loglathe.functions.detect import is_csv, is_kv, prompt_context
from loglathe.functions.text import fixed2, iso_timestamp, is_hostname, is_ip, is_printable, strip
from loglathe.operators.detection import detect, profile_formats

BOUNDARIES = [
    ("<34>1 2026-05-09T14:23:01Z host app - - - msg", "syslog_rfc3164", 0.9),
    ("<165>foo", "syslog_rfc3164", 0.9),
    ("<131>Jan 31 04:05:06 edge7 CEF:0|Acme|probe|2.4|77|port sweep|6|src=192.0.2.14", "syslog_rfc3164", 1.0),
    ("<38>Aug 17 23:59:58 build3 sudo: mira : TTY=pts/2 ; COMMAND=/bin/ls", "syslog_rfc3164", 1.0),
    ("<4>Dec  1 00:00:00 gw2 kernel: dropped packet IN=eth1 LEN=60", "syslog_rfc3164", 1.0),
    ("cef:1|x", "cef", 1.0),
    ("[2026-05-09 14:23:01] INFO started", "json", 1.0),
    ('{"EventID":1,"x":"<System>"}', "evtx_xml", 1.0),
    ("hello />", "xml", 1.0),
    ("<a>b</a>", "xml", 1.0),
    ('<?xml version="1.0"?>', "xml", 1.0),
    ("<a>", "plaintext", 0.6),
    ("a,b,c,d", "csv", 0.85),
    (",a,b,c,d", "csv", 0.85),
    ("a=1,b=2,c=3,d=4", "csv", 0.85),
    ("Cat,b,c,d", "plaintext", 0.6),
    ("a,b,c", "plaintext", 0.6),
    (",a,b,c", "plaintext", 0.6),
    ("a=1 b=2 c=3", "kv", 0.85),
    ("a=bc=de=f", "kv", 0.85),
    ("a=1 b=2", "plaintext", 0.6),
    ("café noir", "plaintext", 0.6),
    ("a\tb", "unknown", 0.0),
    ("two\nlines", "unknown", 0.0),
    ("a b", "unknown", 0.0),
    ("", "unknown", 0.0),
    (" \t　\x1f ", "unknown", 0.0),
    ("k=v " * 200000, "kv", 0.85),
    ("x" * 100000 + "=", "plaintext", 0.6),
]


def test_boundaries(lines):
    got = detect(lines([b[0] for b in BOUNDARIES])).orderBy("line_id").select("hint.*").collect()
    for (raw, label, confidence), hint in zip(BOUNDARIES, got):
        assert (hint["format"], hint["confidence"]) == (label, confidence), raw[:60]
        assert hint["raw_sample"] == raw.strip()[:200]


def test_strip_is_unicode_strip(spark):
    blank = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    values = ["".join(blank) + "a b" + "".join(blank), "", "x"] + [c + "​" + c for c in blank]
    got = spark.createDataFrame([(v,) for v in values], "v STRING").select("v", strip(F.col("v")).alias("s")).collect()
    assert all(row["s"] == row["v"].strip() for row in got)


def _random_texts(alphabet, count, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def test_kv_equals_the_repeated_pair_form(spark):
    """The linear pattern finds a triple exactly where three repeated key=value pairs match."""
    pattern = re.compile(r"(?:\w[\w.\-]*=\S+\s*){3,}")
    texts = _random_texts("a=b=. -_=é\t", 6000, 24, 1)
    got = spark.createDataFrame([(t,) for t in texts], "v STRING").select("v", is_kv(F.col("v")).alias("m")).collect()
    assert sum(row["m"] for row in got) > 200
    assert [row["v"] for row in got if row["m"] != bool(pattern.search(row["v"]))] == []


def test_csv_equals_the_backtracking_form(spark):
    pattern = re.compile(r"^[^<{\[CEF][^\n]*,[^\n]*,[^\n]*,[^\n]*$")
    texts = [t.strip() for t in _random_texts("a,,,b<CE[ \n", 4000, 12, 2)]
    got = spark.createDataFrame([(t,) for t in texts], "v STRING").select("v", is_csv(F.col("v")).alias("m")).collect()
    assert [row["v"] for row in got if row["m"] != bool(pattern.match(row["v"]))] == []


def test_printable(spark):
    codes = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    old = [chr(c) for c in codes if c < 0x250 or 0x2000 <= c < 0x2060 or c == 0x3000]
    got = spark.createDataFrame([(t,) for t in old], "v STRING").select("v", is_printable(F.col("v")).alias("m")).collect()
    assert [hex(ord(r["v"])) for r in got if r["m"] != r["v"].isprintable()] == []


@pytest.mark.parametrize(
    "value, ip, host",
    [
        ("999.9.9.9", True, False),
        ("::", True, False),
        ("12:34:56", True, False),
        ("::ffff:1.2.3.4", False, False),
        ("10.0.0.5:443", False, False),
        ("web-01", False, True),
        ("host.example.com", False, False),
        ("1web", False, False),
        ("", False, False),
    ],
)
def test_address_shapes(spark, value, ip, host):
    row = spark.range(1).select(is_ip(F.lit(value)).alias("ip"), is_hostname(F.lit(value)).alias("host")).first()
    assert (row["ip"], row["host"]) == (ip, host)


def test_fixed2_prints_binary_value(spark):
    rng = random.Random(3)
    values = [0.285, 0.125, 0.705, 0.995, 0.015, 0.7, 1.0, 0.0] + [k / 200 for k in range(201)]
    values += [rng.random() for _ in range(3000)] + [round(rng.random(), 3) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v DOUBLE").select("v", fixed2(F.col("v")).alias("t")).collect()
    assert [r["v"] for r in got if r["t"] != f"{r['v']:.2f}"] == []


def test_prompt_context(lines):
    text = detect(lines(["CEF:0|a"])).select(prompt_context(F.col("hint")).alias("t")).first()["t"].split("\n")
    assert text[0] == "[PRE-PROCESSOR HINT]"
    assert text[1].startswith("Detected format     : CEF (ArcSight Common Event Format). Structure:")
    assert text[2:] == ["Detector confidence : 1.00", "Raw sample          : CEF:0|a"]


def test_profile(lines):
    rows = profile_formats(lines(["a,b,c,d", "a,b,c,e", "x"])).collect()
    assert {(r["format_hint"], r["lines"]) for r in rows} == {("csv", 2), ("plaintext", 1)}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_iso_timestamp(spark, zone):
    texts = {"2026-03-29T01:30:00Z": "2026-03-29T01:30:00+00:00", "2026-10-25T00:30:00.5Z": "2026-10-25T00:30:00.500000+00:00"}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", iso_timestamp(F.to_timestamp("t")).alias("v"))
        assert {r["t"]: r["v"] for r in df.collect()} == texts
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
