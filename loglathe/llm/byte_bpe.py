"""Byte-level encoding of texts to token ids, and ids back to text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm.transducer import Transducer, read_ranks
from loglathe.llm.utf8 import TokenText, Utf8

#: Pieces whose ids a worker remembers, and the longest such piece in characters.
CACHED_PIECES = 300_000
CACHED_LENGTH = 48
#: Pieces or ids of one text that are held at a time, and bytes of finished rows after which a batch is handed on.
STEP = 1 << 16
BATCH_BYTES = 4 << 20
#: A text of more characters is cut into pieces one by one and not at once.
LONG_TEXT = 1 << 18
#: Characters up to here have been in the same classes in all versions of Unicode that count.
_NEWER = re.compile("[^\x00-ԯ]")
_CLASSES = (r"\p{L}", r"\p{N}", r"\s")
#: Stand-ins of each class that no other part of a pattern names, and one of no class.
_STAND_INS = ("é", "²", " ", "")


class Splitter:
    """Matches of the vocabulary's pattern, with the character classes of the library that the ids are compared with.

    The two regular expression libraries know different versions of Unicode.  A character that one of them takes for a
    letter, digit or space and the other doesn't is matched as a stand-in of its class.
    """

    def __init__(self, pattern: str) -> None:
        import tiktoken

        self.pattern = regex.compile(pattern)
        single = {bytes([b]): b for b in range(256)}
        self.theirs = [
            tiktoken.Encoding(f"class {c}", pat_str=c, mergeable_ranks=single, special_tokens={}) for c in _CLASSES
        ]
        self.ours = [regex.compile(c) for c in _CLASSES]
        self.known: set[str] = set()
        self.stand_ins: dict[int, str] = {}

    def _learn(self, text: str) -> None:
        for char in set(text) - self.known:
            self.known.add(char)
            theirs = [bool(e.encode_ordinary(char)) for e in self.theirs]
            if theirs != [bool(r.match(char)) for r in self.ours]:
                self.stand_ins[ord(char)] = _STAND_INS[theirs.index(True) if any(theirs) else -1]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches in order, many at a time; what lies between matches is left out."""
        seen = text
        if _NEWER.search(text):
            self._learn(text)
            if self.stand_ins:
                seen = text.translate(self.stand_ins)
        if len(text) <= LONG_TEXT and seen is text:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(seen)
        while spans := list(islice(found, STEP)):
            yield [text[m.start() : m.end()] for m in spans]


class _Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers; unknown ones go through the transducer."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Decoder:
    """Text of the ids of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = TokenText({i: t for t, i in ranks.items()})

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; ids without token and bytes that are no character become U+FFFD."""
        every, reader = np.frombuffer(ids, "<u4", len(ids) // 4), Utf8()
        parts = [self.tokens.feed(every[at : at + STEP], reader) for at in range(0, len(every), STEP)]
        return b"".join(parts) + reader.close()


class Encoder:
    """Ids of texts by one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.splitter = Splitter(pattern)
        self.known = _Pieces(self.transducer)

    def encode(self, text: str) -> bytes:
        return b"".join(b"".join(map(self.known.__getitem__, some)) for some in self.splitter.pieces(text))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _mapped(rows: DataFrame, keep: Sequence[str], source: str, fields: Sequence[T.StructField], work) -> DataFrame:
    """``keep`` and the columns that ``work`` (a maker of a function of bytes to a tuple) makes of the bytes of ``source``."""
    names = [f.name for f in fields]
    for name in names:
        if name in keep:
            raise ValueError(f"the new column {name!r} is also among those to keep")
    own = "_source"
    while own in keep:
        own += "_"
    given = rows.select(*keep, F.coalesce(F.col(source).cast("binary"), F.lit(b"")).alias(own))
    schema = T.StructType([*(given.schema[c] for c in keep), *fields])
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = work()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(own))
            others = [batch.column(batch.schema.get_field_index(c)) for c in keep]

            def closed(begin: int, done: list[tuple[bytes, ...]]) -> pa.RecordBatch:
                made = [pa.array(values, pa.binary()).cast(kind) for values, kind in zip(zip(*done), kinds)]
                return pa.RecordBatch.from_arrays([*(o.slice(begin, len(done)) for o in others), *made], [*keep, *names])

            begin, size, done = 0, 0, []
            for value in column:
                done.append(one(value.as_py()))
                size += sum(map(len, done[-1]))
                if size > BATCH_BYTES:
                    yield closed(begin, done)
                    begin, size, done = begin + len(done), 0, []
            if done:
                yield closed(begin, done)

    return given.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids``: the ids of each whole text as little-endian unsigned 32-bit integers, one after the other.

    Each match of ``pattern`` is encoded separately by the ranks in the file at ``path``; no special tokens.  A null or
    empty text has no ids; bytes that are not UTF-8 count as U+FFFD.  Rows are encoded one by one: repeated rows and null
    ids stay, other columns change nothing, an empty table gives an empty one.  ``keep`` may not hold ``ids``.

    A text of any length needs its own bytes and its ids in memory, and is cut into pieces some at a time.
    """

    def work():
        coder = encoder(path, pattern)
        return lambda data: (coder.encode(data.decode("utf-8", "replace")),)

    return _mapped(docs, keep, text, [T.StructField("ids", T.BinaryType())], work)


def decode(rows: DataFrame, path: str, keep: Sequence[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``text``: what ids as ``encode`` writes them stand for.

    Ids are taken some at a time; a character that is split over tokens is put together by a state machine.  A null or
    empty sequence is the empty text; ids without token, and bytes that are no character, become U+FFFD.  Up to three
    bytes after the last whole id are ignored.  ``keep`` may not hold ``text``.
    """

    def work():
        back = decoder(path).decode
        return lambda data: (back(data),)

    return _mapped(rows, keep, ids, [T.StructField("text", T.StringType())], work)


def recode(docs: DataFrame, path: str, pattern: str, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep``, ``ids`` and ``decoded``: ``encode``, and what ``decode`` makes of these ids, by one worker for each task.

    One after the other, the two would hold two workers for each task.  Workers are used again for either, so that before
    long all of them would hold the memory that encoding takes.  ``keep`` may hold neither new column.
    """

    def work():
        coder, back = encoder(path, pattern), decoder(path).decode

        def both(data: bytes) -> tuple[bytes, bytes]:
            ids = coder.encode(data.decode("utf-8", "replace"))
            return ids, back(ids)

        return both

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return _mapped(docs, keep, text, fields, work)
