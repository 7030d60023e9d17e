"""Beginnings of files: the first line that is not blank, and as much as a check of the file's head needs."""

from __future__ import annotations

import codecs
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import fixed
from .store import Found, list_store, stream_of

SCHEMA = "file_path STRING, file_name STRING, suffix STRING, sample STRING, head STRING, error STRING, bytes_read BIGINT"
#: Files that a task opens, and bytes that are read at a time.
TASK_FILES, BLOCK_BYTES = 512, 8 << 10


def suffix_of(name: str) -> str:
    stem, dot, last = name.rpartition(".")
    return f".{last}".lower() if dot else ""


def first_line(stream, chars: int) -> tuple[str | None, str, int]:
    """The first line with more than white space, stripped; the first ``chars`` characters, line ends as line feeds; bytes
    read.  Reading stops as soon as both are known; blank lines before are not kept."""
    decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("replace"), translate=True)
    head, begun, count = "", [], 0
    while True:
        block = stream.read(BLOCK_BYTES)
        count += len(block)
        text = decoder.decode(block, final=not block)
        head = head + text if len(head) < chars else head
        if not begun:
            text = text.lstrip(fixed.WHITESPACE)  # line feeds are white space too
        begun += [text] if text else []
        ended = bool(begun) and "\n" in text
        if not block or (ended and len(head) >= chars):
            line = "".join(begun).split("\n", 1)[0].strip(fixed.WHITESPACE)
            return line or None, head[:chars], count
        if ended:
            begun = ["".join(begun).split("\n", 1)[0] + "\n"]


class _Group(InputPartition):
    def __init__(self, files: list[Found]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.tolerant = options.get("tolerant", "true").lower() == "true"

    def partitions(self) -> list[_Group]:
        files = list_store(self.path)
        return [_Group(files[k : k + TASK_FILES]) for k in range(0, len(files), TASK_FILES)] or [_Group([])]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        rows = [self._row(f) for f in partition.files]
        if rows:
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            kinds = [pa.string()] * 6 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def _row(self, file: Found) -> tuple:
        suffix = suffix_of(file.name)
        sample, head, error, count = None, "", None, 0
        if suffix != ".evtx":
            chars = fixed.EVTX_HEAD_CHARS if suffix in (".xml", ".log") else 0
            try:
                with stream_of(self.path, file.inner, file.name) as stream:
                    sample, head, count = first_line(stream, chars)
            except OSError as problem:
                if not self.tolerant:
                    raise
                error = str(problem)
        return file.shown, file.name, suffix, sample, head, error, count


class FileHeads(DataSource):
    """``file_heads``: a row for each file at a path, which is read only up to the end of its first line that is not blank
    and, for ``.xml`` and ``.log`` files, as far as their head goes.  ``error`` says why a file can't be read; with
    ``tolerant`` false, that fails the job.  Tasks take groups of files."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
