"""Lines of objects that may be envelopes of any size: records come one by one, never the whole object."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from .store import open_store, stream_of

SCHEMA = "file_path STRING, line_id BIGINT, raw STRING, error STRING"
BLOCK_BYTES = 256 << 10
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Bytes of objects for a task, on average.
TASK_BYTES = 32 << 20
#: Objects up to which they are dealt by size; more are dealt by name and even out.
FEW_OBJECTS = 10_000
#: Line boundaries of Unicode text.
_BREAKS = re.compile(r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85  ]")
_MARKS = re.compile(r'["{}\[\],:]')
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_SPACE = " \t\n\r"


class NoEnvelope(Exception):
    """The text is not one object with a filled list under the key of records."""


class _Scanner:
    """Values of a JSON text that comes in parts.  It keeps the value that it is in and nothing before."""

    def __init__(self, parts: Iterator[str]) -> None:
        self.parts, self.text, self.at = parts, "", 0

    def _more(self) -> bool:
        part = next(self.parts, "")
        self.text, self.at = self.text[self.at :] + part, 0
        return bool(part)

    def peek(self) -> str:
        """The next character that is not white space; empty at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in _SPACE:
                    return self.text[self.at]
                self.at += 1
            if not self._more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise NoEnvelope(f"expected {wanted!r}")
        self.at += 1

    def value(self) -> str:
        """The text of the value that comes next.  Where it ends follows from brackets and strings; what it holds is not
        checked here."""
        if self.peek() in ("", ",", ":", "]", "}"):
            raise NoEnvelope("expected a value")
        depth, place = 0, 0  # places are counted from the value's beginning, which moves when more text comes
        while True:
            mark = _MARKS.search(self.text, self.at + place)
            if mark is None:
                place = len(self.text) - self.at
                if not self._more():
                    if depth:
                        raise NoEnvelope("unfinished value")
                    break
                continue
            place, char = mark.start() - self.at, mark[0]
            if char == '"':
                while (end := _STRING_END.match(self.text, self.at + place + 1)) is None:
                    if not self._more():
                        raise NoEnvelope("unfinished text")
                place = end.end() - self.at
            elif char in "{[":
                depth, place = depth + 1, place + 1
            elif depth == 0:
                break  # a comma, colon or bracket of what the value stands in
            else:
                depth, place = depth - (char in "}]"), place + 1
            if depth == 0 and char in '"}]':
                break
        found = self.text[self.at : self.at + place]
        self.at += place
        return found

    def read(self):
        """The value that comes next.  An object, list or text that is whole in what is held is read in place; others go
        by their text, as it takes the next mark to know where they end."""
        if self.peek() in ("{", "[", '"'):
            try:
                found, self.at = _READER.raw_decode(self.text, self.at)
                return found
            except (ValueError, RecursionError):
                pass  # unfinished, or no JSON: the text tells
        return _parsed(self.value())


def _parsed(text: str):
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError) as problem:
        raise NoEnvelope(str(problem)) from None


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


_READER = json.JSONDecoder(parse_constant=_refuse)
_written = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def records(parts: Iterator[str], key: str = "Records", write=_written) -> Iterator[tuple[int, str]]:
    """``(n, record)``: the records, as compact JSON, of the n-th value under ``key``; raises ``NoEnvelope`` where the text
    turns out to be something else, which may be after some records."""
    scanner, nth, first = _Scanner(parts), -1, True
    scanner.take("{")
    while scanner.peek() != "}" or not first:
        name = scanner.read()
        if not isinstance(name, str):
            raise NoEnvelope("a key is a text")
        scanner.take(":")
        if name != key:
            scanner.read()
        else:
            nth += 1
            if scanner.peek() != "[":
                scanner.read()
                yield nth, ""
            else:
                scanner.take("[")
                while scanner.peek() != "]":
                    yield nth, write(scanner.read())
                    if scanner.peek() != ",":
                        break
                    scanner.take(",")
                    if scanner.peek() == "]":
                        raise NoEnvelope("a record is missing")
                scanner.take("]")
                yield nth, ""  # this list has ended
        first = False
        if scanner.peek() != ",":
            break
        scanner.take(",")
    scanner.take("}")
    if scanner.peek():
        raise NoEnvelope("more after the object")


def _texts(stream, encoding: str) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(encoding)("replace")
    while block := stream.read(BLOCK_BYTES):
        yield decoder.decode(block)
    yield decoder.decode(b"", True)


def _trimmed(parts: Iterator[str]) -> Iterator[str]:
    """Without white space (of any kind) in front and behind, and without empty parts."""
    begun, held = False, ""
    for part in parts:
        if not begun:
            part = part.lstrip(fixed.WHITESPACE)
        if not part:
            continue
        begun = True
        solid = part.rstrip(fixed.WHITESPACE)
        if solid:
            yield held + solid
            held = part[len(solid) :]
        else:
            held += part


def lines(open_stream, key: str = "Records", encoding: str = "utf-8") -> Iterator[str]:
    """Records of a filled envelope, otherwise the lines that are not blank.  ``open_stream`` opens the object: it is read
    once to see what it is, and once more for its rows.  Of several lists under one key the last counts."""
    chosen, counts = -1, {}
    with open_stream() as stream:
        try:
            for nth, record in records(_trimmed(_texts(stream, encoding)), key, lambda value: "whole"):
                counts[nth] = counts.get(nth, 0) + bool(record)
            chosen = max(counts, default=-1)
        except NoEnvelope:
            chosen = -1
    with open_stream() as stream:
        if chosen >= 0 and counts[chosen]:
            yield from (r for n, r in records(_trimmed(_texts(stream, encoding)), key) if n == chosen and r)
            return
        held = ""
        for part in _texts(stream, encoding):
            # a carriage return at the end may be half of a line end
            *whole, held = _BREAKS.split(held + part) if not part.endswith("\r") else [held + part]
            yield from (line for line in whole if line.strip(fixed.WHITESPACE))
        yield from (line for line in _BREAKS.split(held) if line.strip(fixed.WHITESPACE))


def read_keys(keys: DataFrame, tolerant: bool = False, key: str = "Records", encoding: str = "utf-8") -> DataFrame:
    """``file_path, line_id, raw, error`` of the objects in ``keys`` (``file_path, length``).

    Keys are rows and are dealt to tasks, which open the objects themselves; the driver sees none of them.  With
    ``tolerant`` an object that can't be read gives one row with ``error``, after the lines that could be read if reading
    broke off; otherwise the job fails.
    """
    codecs.lookup(encoding)
    total = keys.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    if total["n"] > FEW_OBJECTS:
        place = F.xxhash64("file_path")
    else:  # names and sizes only; dealt at random, large objects would meet in one task
        place = F.row_number().over(Window.orderBy(F.desc("length"), "file_path"))
    tasks = max(1, min(total["n"], max(keys.sparkSession.sparkContext.defaultParallelism, total["bytes"] // TASK_BYTES)))
    names, kinds = ["file_path", "line_id", "raw", "error"], [pa.string(), pa.int64(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for some in batches:
            for path in some.column("file_path").to_pylist():
                def opened(inner=open_store(unquote(path))[1], path=path):
                    return stream_of(path, inner, inner)

                try:
                    for k, raw in enumerate(lines(opened, key, encoding)):
                        rows.append((path, k, raw, None))
                        size += len(raw)
                        if len(rows) >= BATCH_ROWS or size > BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                except OSError as problem:
                    if not tolerant:
                        raise
                    rows.append((path, None, None, str(problem)))
        if rows:
            yield batch(rows)

    dealt = keys.select("file_path", F.pmod(place, F.lit(tasks)).cast("int").alias("task")).repartitionById(tasks, "task")
    return dealt.select("file_path").mapInArrow(run, SCHEMA)
