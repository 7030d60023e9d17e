"""Log normalisation as Spark plans: raw lines in, validated events, OCSF and CEF out.

Jobs a user runs, each one Spark plan over a whole dataset.
"""

from .operators.assembly import assemble
from .operators.dedup import dedup_new, distinct_lines
from .operators.detection import detect, profile_formats, with_format
from .operators.extraction import build_prompt, extract_rules, extract_with
from .operators.framing import frame_chunks, frame_datagrams
from .operators.metrics import source_counts, status_counts
from .operators.unwrap import object_lines, split_text, unwrap_records
from .plans.jobs import heal, parse, parse_batch
from .plans.index import HashIndex
from .plans.ledger import RunLedger
from .plans.sinks import Sinks, failed_lines, retry_failed, route, run_batch, to_cef, to_ocsf
from .sources.config import union_sources
from .sources.files import (
    ProcessedKeys,
    detect_files,
    load_objects,
    new_keys,
    profile_files,
    read_lines,
    read_objects,
    take_objects,
)
from .streaming.run import distinct_within, frame_chunk_stream, run_stream

__all__ = [
    "HashIndex",
    "ProcessedKeys",
    "RunLedger",
    "Sinks",
    "assemble",
    "build_prompt",
    "dedup_new",
    "detect",
    "detect_files",
    "distinct_lines",
    "extract_rules",
    "extract_with",
    "failed_lines",
    "frame_chunk_stream",
    "frame_chunks",
    "frame_datagrams",
    "heal",
    "load_objects",
    "new_keys",
    "object_lines",
    "parse",
    "parse_batch",
    "profile_files",
    "profile_formats",
    "read_lines",
    "read_objects",
    "retry_failed",
    "route",
    "run_batch",
    "distinct_within",
    "run_stream",
    "source_counts",
    "split_text",
    "status_counts",
    "take_objects",
    "to_cef",
    "to_ocsf",
    "union_sources",
    "unwrap_records",
    "with_format",
]
