"""Registered queries: every operator over whole derived tables."""

from __future__ import annotations

import gzip
import time
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loglathe.functions import answers as a, detect as d, formats, heal as h
from loglathe.functions.text import date_in_raw, decode, event_hash, fixed2, is_hostname, is_ip, strip
from loglathe.operators import dedup, framing, healing, metrics, unwrap
from loglathe.operators.assembly import assemble
from loglathe.operators.detection import detect, profile_formats, with_format
from loglathe.operators.extraction import build_prompt, extract_rules, extract_with, with_rule_fields
from loglathe.operators.storage import create_file, delete_path, with_cleanup, work_path
from loglathe.plans import jobs
from loglathe.plans.index import HashIndex
from loglathe.plans.ledger import RunLedger
from loglathe.plans.sinks import Sinks, _write_run, route, run_batch, to_cef, to_json_lines, to_ocsf
from loglathe.schema import EVENT_COLUMNS
from loglathe.sources import files
from loglathe.sources.config import union_sources
from loglathe.streaming.connections import STORE, STORE_SETTING, frame_connections
from loglathe.streaming.run import flush_open, frame_chunk_stream, run_stream

from . import corpus as c
from .corpus import NOW
from .files import write_files

REGISTRY = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _flat(events: DataFrame, *first: str) -> DataFrame:
    """Event columns with JSON text for the nested ones."""
    nested = {
        "extras": F.to_json("extras"),
        "validation_issues": F.to_json("validation_issues"),
    }
    return events.select(*first, *[nested.get(n, F.col(n)).alias(n) for n in EVENT_COLUMNS])


# --- detection --------------------------------------------------------------------------------------------------
@query
def d1_strip(spark, sf):
    return c.all_lines(spark, sf).select("source", "line_id", strip(F.col("raw")).alias("sample"))


def _predicate(name, fn):
    def run(spark, sf):
        lines = c.all_lines(spark, sf).withColumn("x", strip(F.col("raw")))
        return lines.select("source", "line_id", fn(F.col("x")).alias("matches"))

    REGISTRY[name] = run


_predicate("d2_evtx", d.is_evtx)
_predicate("d3_cef", d.is_cef)
_predicate("d4_syslog", d.is_syslog)
_predicate("d5_json", d.is_json)
_predicate("d6_xml", d.is_xml)
_predicate("d7_csv", d.is_csv)
_predicate("d8_kv", d.is_kv)
_predicate("d9_plaintext", d.is_plaintext)


@query
def d11_detect(spark, sf):
    return detect(c.all_lines(spark, sf)).select(
        "source", "line_id", "hint.format", "hint.confidence", "hint.raw_sample"
    )


@query
def d12_hint(spark, sf):
    return detect(c.all_lines(spark, sf)).select("source", "line_id", "hint.hint")


@query
def d14_prompt_context(spark, sf):
    lines = detect(c.all_lines(spark, sf))
    return lines.select("source", "line_id", d.prompt_context(F.col("hint")).alias("context"))


@query
def profile_formats_(spark, sf):
    return profile_formats(c.all_lines(spark, sf))


REGISTRY["profile_formats"] = REGISTRY.pop("profile_formats_")


def _user_files(spark: SparkSession, sf: str, suffix: str = ".txt") -> str:
    """One text file per user in a new folder, lines in order."""
    lines = c.event_lines(spark, sf).withColumn("event_id", F.col("line_id") % 1000000000000)
    users = c.table(spark, sf, "events").select("event_id", "user_id")
    path = work_path(spark, "files")
    write_files(lines.join(users, "event_id").withColumn("value", F.col("raw")), path, "user_id", "line_id", suffix=suffix)
    return path


def _user():
    return F.regexp_extract("file_path", r"user_id=(\d+)", 1).cast("long").alias("user_id")


@query
def d15_detect_files(spark, sf):
    found = files.detect_files(spark, _user_files(spark, sf))
    return found.select(_user(), "format", "confidence", "hint", "raw_sample")


@query
def profile_files(spark, sf):
    return files.profile_files(spark, _user_files(spark, sf))


# --- extraction -------------------------------------------------------------------------------------------------
@query
def x0_prompt(spark, sf):
    prompts = build_prompt(detect(c.event_lines(spark, sf)))
    return prompts.select("line_id", F.sha2("prompt", 256).alias("prompt_hash"), F.length("prompt").cast("long").alias("prompt_chars"))


def fake_extractor(batch: pd.DataFrame) -> pd.Series:
    """Stands for a model: answers with the line length, fails on lines with a tab."""
    answers = '{"confidence":0.9,"message":"' + batch["raw"].str.len().astype(str) + '"}'
    return answers.astype(object).mask(batch["raw"].str.contains("\t"), RuntimeError("line has a tab"))


@query
def x1_extract_with(spark, sf):
    return extract_with(c.event_lines(spark, sf), fake_extractor).select("line_id", "ai_response", "error")


def _rule(name, *fields):
    def run(spark, sf):
        found = with_rule_fields(c.event_lines(spark, sf))
        return found.select("line_id", *[F.col("found")[f].alias(f) for f in fields])

    REGISTRY[name] = run


_rule("x2_src_ip", "src_ip")
_rule("x3_dst_ip", "dst_ip")
_rule("x4_actor_user", "actor_user")
_rule("x5_source_host", "source_host")
_rule("x6_action", "action")
_rule("x7_target", "target")
_rule("x8_class", "category", "outcome")
_rule("x9_message", "message")
_rule("x10_event_ts", "event_ts")


@query
def x11_extract_rules(spark, sf):
    return extract_rules(c.event_lines(spark, sf)).select("line_id", "ai_response")


# --- answers ----------------------------------------------------------------------------------------------------
def _answers(spark, sf) -> DataFrame:
    return with_format(c.answers(spark, sf)).drop("sample")


def _assembled(spark, sf) -> DataFrame:
    return assemble(_answers(spark, sf), F.lit(NOW))


def _healed(spark, sf) -> DataFrame:
    answer = healing.Answer.of_cells(F.col("cells"))
    return healing.heal_fields(_assembled(spark, sf), answer, F.lit(NOW))


def _events(spark, sf) -> DataFrame:
    return jobs.heal(_answers(spark, sf), NOW)


@query
def r1_extract_json(spark, sf):
    parsed = c.answers(spark, sf).withColumn(
        "j", F.when(F.col("error").isNull(), a.extract_json(F.col("ai_response")))
    )
    return parsed.select(
        "line_id",
        F.col("j").isNotNull().alias("found"),
        F.try_variant_get("j", "$.src_ip", "string").alias("src_ip"),
        F.try_variant_get("j", "$.confidence", "string").alias("confidence"),
        F.to_json(F.try_variant_get("j", "$.extras", "variant")).alias("extras"),
    )


@query
def r2_assemble(spark, sf):
    cells = F.col("cells")
    return _assembled(spark, sf).select(
        "line_id",
        *[cells[k]["kind"].alias(f"{k}_k") for k in a.CELL_KEYS],
        *[cells[k]["text"].alias(f"{k}_t") for k in a.CELL_KEYS],
    )


@query
def r3_event_hash(spark, sf):
    return c.all_lines(spark, sf).select("source", "line_id", event_hash(F.col("raw")).alias("event_hash"))


@query
def r4_fallback(spark, sf):
    failed = _flat(_events(spark, sf), "line_id").where(F.col("message").startswith("[PARSE FAILURE]"))
    return failed.select(
        "line_id", "message", "validation_issues", "confidence", "review_flag", "event_ts", "format_hint"
    )


# --- healing ----------------------------------------------------------------------------------------------------
def _healed_columns(name, *columns):
    REGISTRY[name] = lambda spark, sf: _flat(_events(spark, sf), "line_id").select("line_id", *columns)


_healed_columns("h1_syslog_ts", "format_hint", "event_ts", "ts_source")
_healed_columns("h5_ts_source", "ts_source")
_healed_columns("h11_enums", "category", "outcome")
_healed_columns("h12_confidence", "confidence")
_healed_columns("h13_ip_fields", "src_ip", "dst_ip")
_healed_columns("h14_extras", "extras")


@query
def h2_src_ip_fix(spark, sf):
    return _healed(spark, sf).select(
        "line_id",
        F.col("_src_problem").alias("problem"),
        F.col("_host_text").alias("source_host"),
        F.to_json("_issues").alias("issues"),
    )


@query
def h3_date_in_raw(spark, sf):
    ts = F.regexp_extract("ai_response", '"event_ts":"?([^",]*)', 1)
    found = c.answers(spark, sf).withColumn("ts", ts)
    return found.select(
        "line_id", F.coalesce(date_in_raw(F.col("ts"), F.col("raw")), F.lit(False)).alias("found")
    )


@query
def h4_hallucination(spark, sf):
    return _healed(spark, sf).select(
        "line_id", (F.col("_time_case") == "invented").alias("invented"), F.col("_forced").alias("forced")
    )


@query
def h7_gate(spark, sf):
    return _healed(spark, sf).select(
        "line_id", F.col("_confidence").alias("confidence"), h.below_gate(F.col("_confidence")).alias("below")
    )


def _texts(spark, sf) -> DataFrame:
    cells = F.col("cells")
    values = F.array(cells["src_ip"]["text"], cells["dst_ip"]["text"], cells["source_host"]["text"])
    return _assembled(spark, sf).select("line_id", F.explode(values).alias("v")).where("v IS NOT NULL")


@query
def h9_is_ip(spark, sf):
    return _texts(spark, sf).select("line_id", "v", is_ip(F.col("v")).alias("is_ip"))


@query
def h10_is_hostname(spark, sf):
    return _texts(spark, sf).select("line_id", "v", is_hostname(F.col("v")).alias("is_hostname"))


@query
def h15_quarantine(spark, sf):
    reset = _flat(_events(spark, sf), "line_id").where(F.col("message").startswith("[VALIDATION FAILURE]"))
    return reset.select("line_id", "message", "validation_issues", "confidence", "review_flag", "format_hint")


@query
def h18_safe_parse(spark, sf):
    return _flat(_events(spark, sf), "line_id")


# --- formats ----------------------------------------------------------------------------------------------------
@query
def f1_ocsf(spark, sf):
    doc = formats.ocsf(**{n: F.col(n) for n in EVENT_COLUMNS})
    o = F.col("o")
    return _events(spark, sf).select("line_id", doc.alias("o")).select(
        "line_id",
        *[o[n].alias(n) for n in ("class_uid", "class_name", "category_uid", "severity_id", "status", "status_id")],
        o["type_uid"].alias("type_uid"),
        o["time"].alias("time"),
        o["actor"]["user"]["name"].alias("actor"),
        o["src_endpoint"]["hostname"].alias("src_host"),
        o["src_endpoint"]["ip"].alias("src_ip"),
        o["dst_endpoint"]["hostname"].alias("dst_host"),
        o["dst_endpoint"]["ip"].alias("dst_ip"),
        o["enrichments"]["event_hash"].alias("event_hash"),
    )


@query
def f2_ocsf_json(spark, sf):
    doc = formats.ocsf(**{n: F.col(n) for n in EVENT_COLUMNS})
    return _parsed(spark, sf).select("line_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


@query
def f3_cef_escape(spark, sf):
    return c.all_lines(spark, sf).select("source", "line_id", formats.cef_escape(F.col("raw")).alias("escaped"))


@query
def f4_cef(spark, sf):
    text = formats.cef(**{n: F.col(n) for n in EVENT_COLUMNS})
    return _events(spark, sf).select("line_id", text.alias("value"))


@query
def f5_fixed2(spark, sf):
    price, key = F.col("l_extendedprice"), F.col("l_orderkey")
    return c.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        fixed2(F.col("l_discount")).alias("discount"),
        fixed2(price / (price + 1000.0)).alias("share"),
        fixed2((key % 200) / F.lit(200.0)).alias("half"),
    )


# --- routing ----------------------------------------------------------------------------------------------------
def _parsed(spark, sf) -> DataFrame:
    return jobs.parse(c.event_lines(spark, sf), ingest_ts=NOW)


@query
def w1_route(spark, sf):
    return dedup.with_sink(_parsed(spark, sf)).select("line_id", "sink")


@query
def w2_dedup(spark, sf):
    return dedup.dedup_new(_parsed(spark, sf)).select("line_id", "event_hash", "review_flag")


@query
def w3_dedup_history(spark, sf):
    events = _parsed(spark, sf)
    written = dedup.with_sink(events.where(F.col("category").isin("network", "file")))
    history = written.select("event_hash", "sink").distinct()
    return dedup.dedup_new(events, history).select("line_id", "event_hash", "review_flag")


def _routed(spark, sf) -> Sinks:
    """Outputs of two runs over the same lines; the second adds nothing."""
    sinks = Sinks.under(work_path(spark, "sinks"))
    events = _parsed(spark, sf)
    for batch_id in (0, 1):
        route(events, sinks, batch_id)
    return sinks


def _sink_rows(spark, sinks: Sinks) -> DataFrame:
    confident = spark.read.text(sinks.confident).select(F.lit("confident").alias("sink"), "value")
    return confident.unionByName(spark.read.text(sinks.review).select(F.lit("review").alias("sink"), "value"))


@query
def w6_json_lines(spark, sf):
    return _sink_rows(spark, _routed(spark, sf))


@query
def w7_cef_text(spark, sf):
    return spark.read.text(_routed(spark, sf).cef).select("value")


@query
def w8_stream(spark, sf):
    sinks = Sinks.under(work_path(spark, "stream"))
    lines = files.read_lines(spark, _line_files(spark, c.event_lines(spark, sf)), streaming=True, maxFilesPerTrigger=4)
    run_stream(lines, sinks, work_path(spark, "offsets"), ingest_ts=NOW).awaitTermination()
    event = F.from_json("value", "event_hash STRING, message STRING, format_hint STRING")
    return _sink_rows(spark, sinks).select("sink", event.alias("e")).select("sink", "e.*")


def _sink_events(spark, sinks: Sinks) -> DataFrame:
    event = F.from_json("value", "event_hash STRING, message STRING, format_hint STRING")
    return _sink_rows(spark, sinks).select("sink", event.alias("e")).select("sink", "e.*")


def _stream_into(spark, path: str, sinks: Sinks, checkpoint: str, **options) -> None:
    lines = files.read_lines(spark, path, streaming=True, maxFilesPerTrigger=4, **options)
    run_stream(lines, sinks, checkpoint, ingest_ts=NOW).awaitTermination()


@query
def w8_restart(spark, sf):
    """A stream over the even lines, then one with a new checkpoint over all."""
    sinks, lines = Sinks.under(work_path(spark, "restart")), c.event_lines(spark, sf)
    _stream_into(spark, _line_files(spark, lines.where("line_id % 2 = 0")), sinks, work_path(spark, "offsets"))
    _stream_into(spark, _line_files(spark, lines), sinks, work_path(spark, "offsets"))
    return _sink_events(spark, sinks)


@query
def w8_within(spark, sf):
    """The lines twice in one stream, the second time in reverse, that is held together by streaming state alone."""
    sinks, lines = Sinks.under(work_path(spark, "within")), c.event_lines(spark, sf)
    again = lines.withColumn("line_id", -F.col("line_id"))
    path, checkpoint = _line_files(spark, lines), work_path(spark, "offsets")
    stream = files.read_lines(spark, path, streaming=True, maxFilesPerTrigger=4)
    run_stream(stream, sinks, checkpoint, ingest_ts=NOW, dedup_within="2 hours").awaitTermination()
    again.select("raw").coalesce(4).write.mode("append").text(path)
    stream = files.read_lines(spark, path, streaming=True, maxFilesPerTrigger=4)
    run_stream(stream, sinks, checkpoint, ingest_ts=NOW, dedup_within="2 hours").awaitTermination()
    return _sink_events(spark, sinks)


@query
def w8_after_batch(spark, sf):
    """A batch run over a third of the lines, then a stream over all."""
    sinks, lines = Sinks.under(work_path(spark, "mixed")), c.event_lines(spark, sf)
    run_batch(lines.where("line_id % 3 = 0"), sinks, ingest_ts=NOW)
    _stream_into(spark, _line_files(spark, lines), sinks, work_path(spark, "offsets"))
    return _sink_events(spark, sinks)


class _Lost(Exception):
    pass


class _LosingIndex(HashIndex):
    def add(self, events, run):
        raise _Lost


@query
def w6_lost_run(spark, sf):
    """A run over half of the lines that is lost between counts and index, then runs over half and all."""
    sinks, lines = Sinks.under(work_path(spark, "lost")), c.event_lines(spark, sf)
    half = lines.where("line_id % 2 = 1")
    ledger = RunLedger(spark, sinks.runs)
    number = ledger.begin("batch")
    try:
        events = dedup.dedup_new(jobs.parse(half, ingest_ts=NOW))
        _write_run(events, sinks, number, ledger, _LosingIndex(spark, sinks.index), formats.PRODUCT, all_new=False)
    except _Lost:
        ledger.left(number)
    run_batch(half, sinks, ingest_ts=NOW)
    run_batch(lines, sinks, ingest_ts=NOW)
    return _sink_events(spark, sinks)


def late_extractor(batch: pd.DataFrame) -> pd.Series:
    """The same model as ``fake_extractor`` when it is up again."""
    return '{"confidence":0.9,"message":"' + batch["raw"].str.len().astype(str) + '"}'


@query
def w2_retry(spark, sf):
    """A run whose model fails on lines with a tab, then one in which it answers all."""
    sinks, lines = Sinks.under(work_path(spark, "retry")), c.event_lines(spark, sf)
    run_batch(lines, sinks, extractor=fake_extractor, ingest_ts=NOW)
    run_batch(lines, sinks, extractor=late_extractor, ingest_ts=NOW)
    return _sink_events(spark, sinks)


@query
def w3_index(spark, sf):
    """Six runs of a line each in an index that keeps two side by side; what all lines find of the first five."""
    hashed = dedup.with_sink(_parsed(spark, sf)).select("line_id", "event_hash", "review_flag", "sink")
    index = HashIndex(spark, work_path(spark, "index"))
    for run in range(6):
        index.add(hashed.where(F.col("line_id") % 6 == run).select("event_hash", "review_flag").distinct(), run)
        index.merge(2)
    return index.seen(hashed, 5).distinct()


@query
def w5_ocsf_dedup(spark, sf):
    value = F.from_json("value", "enrichments STRUCT<event_hash STRING>")["enrichments"]["event_hash"]
    return spark.read.text(_routed(spark, sf).ocsf).select(value.alias("event_hash"))


@query
def m1_observed(spark, sf):
    """Counts of a run, taken while its events are written."""
    counts = run_batch(c.event_lines(spark, sf), Sinks.under(work_path(spark, "observed")), ingest_ts=NOW)
    return counts.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query
def m1_status_counts(spark, sf):
    return metrics.status_counts(_parsed(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query
def m2_source_counts(spark, sf):
    return metrics.source_counts(c.all_lines(spark, sf))


@query
def p1_parse(spark, sf):
    return _flat(_parsed(spark, sf), "line_id")


@query
def p2_parse_batch(spark, sf):
    lines = c.event_lines(spark, sf)
    hints = detect(lines).select("line_id", "hint.format")
    return _flat(jobs.parse_batch(lines, hints, NOW), "line_id")


# --- sources ----------------------------------------------------------------------------------------------------
def _line_files(spark: SparkSession, lines: DataFrame, **options) -> str:
    path = work_path(spark, "lines")
    lines.select(F.col("raw").alias("value")).write.options(**options).text(path)
    return path


@query
def s1_read_lines(spark, sf):
    return files.read_lines(spark, _line_files(spark, c.all_lines(spark, sf))).select("raw")


@query
def s2_start_latest(spark, sf):
    """Files of events, and later ones of all else; only what came after the time in between."""
    lines, path = c.all_lines(spark, sf), work_path(spark, "lines")
    text = lines.select(F.col("raw").alias("value"), "source")
    text.where("source = 'events'").select("value").write.text(f"{path}/early")
    time.sleep(1.1)
    since = spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
    time.sleep(1.1)
    text.where("source <> 'events'").select("value").write.text(f"{path}/late")
    return files.read_lines(spark, path, start="latest", start_time=since).select("raw")


@query
def s2_growing(spark, sf):
    """A stream by bytes over a folder that gets more between two runs of the stream."""
    path, out, checkpoint = (work_path(spark, n) for n in ("growing", "grown", "offsets"))
    text = c.all_lines(spark, sf).select(F.col("raw").alias("value"), "source")
    for part in ("source = 'events'", "source <> 'events'"):
        text.where(part).select("value").write.mode("append").text(path)
        stream = files.read_lines(spark, path, streaming=True, growing=True, rangeBytes=1 << 20)
        query = stream.select("raw").writeStream.format("parquet").option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("raw")


@query
def s12_tolerant_read(spark, sf):
    path = _line_files(spark, c.all_lines(spark, sf), compression="gzip")
    create_file(spark, f"{path}/broken.txt.gz", "no gzip")
    return files.read_lines(spark, path, tolerant=True).select("raw")


@query
def s12_retry(spark, sf):
    """Objects of events and one that is broken; then it is whole, and only it is read."""
    path, out = work_path(spark, "objects"), work_path(spark, "taken")
    keys = files.ProcessedKeys(spark, work_path(spark, "keys"))
    c.event_lines(spark, sf).select(F.col("raw").alias("value")).write.text(f"{path}/events")
    create_file(spark, f"{path}/broken/late.txt.gz", "no gzip")
    for run in range(2):
        files.take_objects(spark, path, keys, lambda lines, run=run: lines.write.parquet(f"{out}/run={run}"), run)
        if not run:
            delete_path(spark, f"{path}/broken/late.txt.gz")
            create_file(spark, f"{path}/broken/late.txt.gz", gzip.compress(b"late\n"))
            talk = c.all_lines(spark, sf).where("source = 'conversations'").select(F.col("raw").alias("value"))
            talk.write.option("compression", "gzip").text(f"{path}/talk")
    return spark.read.parquet(out).select("raw")


@query
def s3_read_objects(spark, sf):
    path = _user_files(spark, sf, ".txt.gz")
    return files.read_objects(spark, path, prefix="user_id=").select(_user(), "text")


@query
def s5_unwrap_records(spark, sf):
    return unwrap.unwrap_records(c.objects(spark, sf))


@query
def s6_split_text(spark, sf):
    return c.all_lines(spark, sf).where("source <> 'events'")


@query
def load_objects(spark, sf):
    return unwrap.object_lines(c.objects(spark, sf)).select("object_id", "raw")


@query
def s7_new_keys(spark, sf):
    events = c.table(spark, sf, "events")
    key = F.concat(F.lit("logs/"), F.col("user_id").cast("string"), F.lit("/"), F.substring(F.col("ts").cast("string"), 1, 10))
    keyed = events.select(key.alias("file_path"), "event_type")
    processed = keyed.where("event_type = 'error'")
    return files.new_keys(keyed.select("file_path").distinct(), processed)


@query
def s9_frame_datagrams(spark, sf):
    return framing.frame_datagrams(c.datagrams(spark, sf))


@query
def s10_frame_chunks(spark, sf):
    return framing.frame_chunks(c.chunks(spark, sf)).select("conn_id", "raw")


@query
def s11_union_sources(spark, sf):
    """A source of each kind, and one more file source."""
    lines, paths = c.all_lines(spark, sf), {}
    for name in ("events", "documents", "pages"):
        paths[name] = _line_files(spark, lines.where(F.col("source") == name))
    paths["conversations"] = work_path(spark, "captured")
    payload = F.encode(F.concat("raw", F.lit("\n")), "utf-8").alias("payload")
    lines.where("source = 'conversations'").select(payload).write.parquet(paths["conversations"])
    blocks = [
        {"type": "file", "path": paths["events"]},
        {"type": "s3", "name": "documents", "bucket": paths["documents"]},
        {"type": "file", "name": "pages", "path": paths["pages"]},
        {"type": "syslog", "name": "conversations", "path": paths["conversations"]},
    ]
    return union_sources(spark, blocks).select("source", "raw")


@query
def s13_decode(spark, sf):
    """Whole texts as UTF-16 and, without what it lacks, Latin-1; and with a byte at the end that is no UTF-8."""
    docs = c.table(spark, sf, "documents")
    latin = F.regexp_replace("text", r"[^\x00-\xff]", "")
    cases = {
        "utf16": decode(F.encode("text", "UTF-16BE"), "UTF-16BE"),
        "latin": decode(F.encode(latin, "ISO-8859-1"), "ISO-8859-1"),
        "broken": decode(F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF")))),
    }
    return reduce(
        DataFrame.unionByName, [docs.select("doc_id", F.lit(k).alias("kind"), v.alias("text")) for k, v in cases.items()]
    )


@query
def s13_encoded_lines(spark, sf):
    """Every line of all tables in files of UTF-16, read in ranges."""
    path = work_path(spark, "encoded")
    c.all_lines(spark, sf).select("source", "line_id", "raw").write.option("encoding", "UTF-16LE").json(path)
    read = files.read_lines(spark, path, encoding="utf-16-le", rangeBytes=256 << 10)
    return read.select(F.from_json("raw", "source STRING, line_id BIGINT, raw STRING").alias("r")).select("r.*")


@query
def s5_mixed_records(spark, sf):
    return unwrap.unwrap_records(c.mixed_objects(spark, sf))


@query
def s5_split_envelopes(spark, sf):
    """All lines of five connections as five envelopes, read record by record."""
    path, lines = work_path(spark, "envelopes"), c.event_lines(spark, sf)
    record = F.concat(F.lit('{ "n" : '), F.col("line_id").cast("string"), F.lit(', "tag":["é", null] }'))
    rows = lines.select((F.col("line_id") % 5).alias("part"), record.alias("value"))
    write_files(rows, path, "part", begin='{"Records":[', between=",\n", end="]}\n", suffix=".json")
    part = F.regexp_extract("file_path", r"part=(\d+)", 1).cast("long").alias("part")
    return files.load_objects(spark, path).select(part, "raw")


@query
def d16_xml_files(spark, sf):
    """Files of records as XML, half with the tags of event logs, and one by whose name it is a binary log."""
    path = work_path(spark, "xml")
    events = c.table(spark, sf, "events")
    record = {"Event": F.struct(F.col("event_id").alias("EventID")).alias("System"), "entry": F.col("event_type").alias("kind")}
    begin = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<ROWS>\n'
    for rest, tag in ((0, "Event"), (1, "entry")):
        text = F.to_xml(F.struct(record[tag]), {"rowTag": tag})
        some = events.where(F.col("user_id") % 2 == rest).select("user_id", text.alias("value"))
        write_files(some, f"{path}/{tag}", "user_id", begin=begin, end="\n</ROWS>\n", suffix=".xml")
    create_file(spark, f"{path}/user_id=-1/log.EVTX", "ElfFile")
    return files.detect_files(spark, path).select(_user_of_any(), "format", "confidence")


def _user_of_any():
    return F.regexp_extract("file_path", r"user_id=(-?\d+)", 1).cast("long").alias("user_id")


def _in_thirds(spark, sf) -> tuple[str, list]:
    """A folder, and three steps, each of which adds a third of the chunks to it as one more folder."""
    path, parts = work_path(spark, "chunks"), work_path(spark, "parts")
    with_cleanup(c.chunks(spark, sf, thirds=True), lambda rows: rows.write.partitionBy("t").parquet(parts))
    schema = "conn_id LONG, seq LONG, payload BINARY"

    def adding(k: int):
        third = spark.read.schema(schema + ", t INT").parquet(parts).where(F.col("t") == k)

        def add() -> None:
            third.drop("t").write.mode("append").parquet(path)
            delete_path(spark, f"{parts}/t={k}")  # on disk once

        return add

    spark.createDataFrame([], schema).write.parquet(path)
    return path, [adding(k) for k in range(3)]


@query
def s10_chunk_stream(spark, sf):
    """Chunks that come in three parts, one after the other; lines of the micro-batches and, at the end, of what is still
    open.  The stream goes on for each part where it left off."""
    out, open_path, offsets = (work_path(spark, n) for n in ("framed", "open", "offsets"))
    path, steps = _in_thirds(spark, sf)

    def write(lines: DataFrame, batch_id: int) -> None:
        lines.select("conn_id", "raw").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for add in steps:
        add()
        stream = spark.readStream.schema("conn_id LONG, seq LONG, payload BINARY").parquet(path)
        frame_chunk_stream(stream, open_path, write, offsets).awaitTermination()
    tails = spark.read.schema("conn_id LONG, tail BINARY, batch_id LONG").parquet(open_path)
    last = tails.join(tails.agg(F.max("batch_id").alias("batch_id")), "batch_id")
    done = spark.read.schema("conn_id LONG, raw STRING").parquet(f"{out}/batch_id=*")
    return done.unionByName(flush_open(last.select("conn_id", "tail")))


@query
def s10_open_connections(spark, sf):
    """Chunks that come in three parts and then the end of every connection, framed by keyed state."""
    out, offsets = work_path(spark, "framed"), work_path(spark, "offsets")
    path, steps = _in_thirds(spark, sf)

    def close() -> None:
        ends = spark.read.parquet(path).groupBy("conn_id").agg(F.max("seq").alias("seq"))
        ends.withColumn("payload", F.lit(None).cast("binary")).write.mode("append").parquet(path)

    before = spark.conf.get(STORE_SETTING)
    spark.conf.set(STORE_SETTING, STORE)
    try:
        for add in (*steps, close):
            add()
            stream = spark.readStream.schema("conn_id LONG, seq LONG, payload BINARY").parquet(path)
            lines = frame_connections(stream).select("conn_id", "raw")
            to = lines.writeStream.option("checkpointLocation", offsets).trigger(availableNow=True)
            to.format("parquet").start(out).awaitTermination()
    finally:
        spark.conf.set(STORE_SETTING, before)
    return spark.read.schema("conn_id LONG, raw STRING").parquet(out)
