"""Declared sources to one table of lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.framing import frame_chunks, frame_datagrams
from .files import load_objects, read_lines

# Name of a source that declares none.
DEFAULT_NAMES = {"file": "FileConnector", "syslog": "SyslogConnector", "s3": "S3Connector"}


class SourceConfigError(ValueError):
    """A source declaration is incomplete or out of range."""


def _require(block: dict, key: str) -> Any:
    if key not in block:
        raise SourceConfigError(f"source {source_name(block)!r}: missing required key {key!r}")
    return block[key]


def source_name(block: dict) -> str:
    return block.get("name", DEFAULT_NAMES.get(block["type"], block["type"]))


def poll_interval(block: dict, default: float) -> float:
    """Seconds between polls, for ``trigger(processingTime=...)``."""
    value = block.get("poll_interval", default)
    try:
        seconds = float(value)
    except (TypeError, ValueError):
        seconds = 0.0
    if not seconds > 0:
        raise SourceConfigError(f"source {source_name(block)!r}: poll_interval must be positive, got {value!r}")
    return seconds


def _check_file(block: dict) -> None:
    _require(block, "path")
    poll_interval(block, 0.25)


def _read_file(spark: SparkSession, block: dict, streaming: bool) -> DataFrame:
    """Lines of files; ``growing`` makes a stream follow files that are appended to."""
    return read_lines(
        spark,
        block["path"],
        streaming,
        start="latest" if block.get("tail", False) else "earliest",
        start_time=block.get("start_time"),
        encoding=block.get("encoding", "utf-8"),
        growing=block.get("growing", False),
    )


def _check_s3(block: dict) -> None:
    _require(block, "bucket")
    poll_interval(block, 30.0)


def _read_s3(spark: SparkSession, block: dict, streaming: bool) -> DataFrame:
    """Objects of a bucket; ``delete_after_read`` lets a stream delete what it has processed."""
    bucket = block["bucket"]
    path = bucket if "/" in bucket else f"s3a://{bucket}"
    options = {"cleanSource": "delete"} if streaming and block.get("delete_after_read", False) else {}
    encoding = block.get("encoding", "utf-8")
    return load_objects(spark, path, block.get("prefix", ""), streaming=streaming, encoding=encoding, **options)


def _check_syslog(block: dict) -> None:
    protocol = block.get("protocol", "udp")
    if str(protocol).lower() not in ("udp", "tcp"):
        raise SourceConfigError(f"source {source_name(block)!r}: protocol must be tcp or udp, got {protocol!r}")
    port = block.get("port", 514)
    try:
        in_range = 1 <= int(port) <= 65535
    except (TypeError, ValueError):
        in_range = False
    if not in_range:
        raise SourceConfigError(f"source {source_name(block)!r}: port must be 1 to 65535, got {port!r}")


def _read_syslog(spark: SparkSession, block: dict, streaming: bool) -> DataFrame:
    """Payloads that a relay wrote as Parquet: ``payload`` per datagram, or ``conn_id, seq, payload`` per chunk."""
    path = _require(block, "path")
    options = {"encoding": block.get("encoding", "utf-8"), "errors": block.get("errors", "replace")}
    if str(block.get("protocol", "udp")).lower() == "udp":
        reader = spark.readStream if streaming else spark.read
        return frame_datagrams(reader.schema("payload BINARY").parquet(path), **options)
    if streaming:
        raise SourceConfigError(f"source {source_name(block)!r}: stream chunks with frame_chunk_stream")
    return frame_chunks(spark.read.parquet(path), **options)


Reader = Callable[[SparkSession, dict, bool], DataFrame]
CHECKS: dict[str, Callable[[dict], None]] = {"file": _check_file, "s3": _check_s3, "syslog": _check_syslog}
READERS: dict[str, Reader] = {
    "file": _read_file,
    "s3": _read_s3,
    "syslog": _read_syslog,
}


def check_sources(blocks: Any) -> list[dict]:
    if not isinstance(blocks, list):
        raise SourceConfigError(f"sources must be a list, got {type(blocks).__name__!r}")
    for i, block in enumerate(blocks):
        if not isinstance(block, dict):
            raise SourceConfigError(f"sources[{i}] must be a mapping, got {type(block).__name__!r}")
        if "type" not in block:
            raise SourceConfigError(f"sources[{i}] is missing required key 'type'")
        if block["type"] in CHECKS:
            CHECKS[block["type"]](block)
    return blocks


def shortest_poll(blocks: list[dict]) -> float:
    """Shortest poll interval of the declared sources: the trigger of one query over all of them."""
    defaults = {"file": 0.25, "s3": 30.0}
    return min(poll_interval(block, defaults.get(block["type"], 1.0)) for block in check_sources(blocks))


def union_sources(
    spark: SparkSession,
    blocks: list[dict],
    readers: dict[str, Reader] | None = None,
    streaming: bool = False,
) -> DataFrame:
    """Every declared source (``type``, ``name`` and options) in one table with ``source`` and ``source_rank``.

    ``readers`` adds types or replaces the reader of a type; a reader gets the session, the block and ``streaming``.
    """
    known = {**READERS, **(readers or {})}
    tables = []
    for rank, block in enumerate(check_sources(blocks)):
        if block["type"] not in known:
            raise SourceConfigError(f"source {source_name(block)!r}: unknown type {block['type']!r}")
        lines = known[block["type"]](spark, block, streaming)
        tables.append(lines.withColumns({"source": F.lit(source_name(block)), "source_rank": F.lit(rank)}))
    if not tables:
        return spark.createDataFrame([], "raw STRING, source STRING, source_rank INT")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
