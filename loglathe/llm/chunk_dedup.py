"""Substring removal by content-defined chunks: a gear hash cuts, equal digests go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.tables import Tables
from loglathe.llm.words import slices, text_bytes

#: Bytes that the rolling hash sees.  A cut depends on them alone, so cuts move with the text when bytes are inserted.
WINDOW = 16
#: A cut after one byte in ``2 ** CUT_BITS`` on average, at least ``LEAST`` bytes after the last and ``MOST`` at most.
CUT_BITS = 5
LEAST = 32
MOST = 512
#: Chunks under this size at the end of a text are never removed.
SMALL = LEAST

_GEAR = np.random.default_rng(23).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, the last one being its length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    rolled, width = _GEAR[data], 1
    while width < WINDOW:  # doubles the window: the older half is shifted on, as byte by byte shifts would do
        older = np.zeros_like(rolled)
        older[width:] = rolled[:-width] << np.uint32(width)
        rolled, width = rolled + older, 2 * width
    # the upper of the window's bits depend on all its bytes
    marks = np.flatnonzero((rolled >> np.uint32(WINDOW - CUT_BITS)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    out, last = [], 0
    while n - last > LEAST:
        at = int(np.searchsorted(marks, last + LEAST))
        end = min(int(marks[at]) if at < len(marks) else n, last + MOST, n)
        while end < n and data[end] & 0xC0 == 0x80:  # not inside a character
            end += 1
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids, marks = batch.column("doc_id"), batch.column("mark")
        for i, j in slices(offsets, 1 << 21):
            row, start, size, digest = [], [], [], []
            for k in range(i, j):
                own = data[offsets[k] : offsets[k + 1]]
                raw, last = own.tobytes(), 0
                for end in cuts(own):
                    if end - last >= SMALL:
                        row.append(k)
                        start.append(last)
                        size.append(end - last)
                        digest.append(hashlib.blake2b(raw[last:end], digest_size=12).digest())
                    last = end
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(at),
                    marks.take(at),
                    pa.array(start, pa.int32()),
                    pa.array(size, pa.int32()),
                    pa.array(digest, pa.binary()),
                ],
                ["doc_id", "mark", "start", "size", "digest"],
            )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        texts = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            raw, at, kept = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
            for s in spans or ():
                kept.append(raw[at : s["start"]])
                at = s["stop"]
            kept.append(raw[at:])
            texts.append(b"".join(kept).decode())
        others = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), pa.array(texts, pa.string())], [*others, "kept"])


def chunk_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, spans`` of the documents that hold a chunk which came before: maximal removed byte ranges.

    A chunk of at least ``SMALL`` bytes goes if its digest is that of a chunk of a document with a smaller ``doc_id``,
    or of an earlier chunk of the same document.  ``mark`` is ``hash`` of the text.  Rows without ``doc_id`` come
    after all others.  Equal rows are one document.
    """
    tables = Tables(docs.sparkSession, "chunks")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = tables.write(
        given.withColumn("mark", F.hash("text")).mapInArrow(
            _chunks, "doc_id long, mark int, start int, size int, digest binary"
        )
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "start")
    firsts = chunks.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = chunks.join(firsts.select("digest", "first"), "digest").where(place != F.col("first"))

    def add(spans, x):
        last = F.get(spans, F.size(spans) - 1)
        grown = F.concat(
            F.slice(spans, F.lit(1), F.size(spans) - 1),
            F.array(F.struct(last["start"].alias("start"), x["stop"].alias("stop"))),
        )
        return F.when((F.size(spans) > 0) & (last["stop"] == x["start"]), grown).otherwise(F.concat(spans, F.array(x)))

    spans = F.array_distinct(
        F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))))
    )
    return (
        again.groupBy("doc_id", "mark")
        .agg(spans.alias("all"))
        .select(
            "doc_id",
            "mark",
            F.aggregate("all", F.array().cast("array<struct<start:int,stop:int>>"), add).alias("spans"),
        )
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: ``doc_id, spans, kept``, the text that remains.

    Cuts are where a gear hash of the last ``WINDOW`` bytes says so, so they lie at the same bytes of a passage wherever
    it stands, whatever was inserted before.  Chunks are shuffled by digest (copies summed up before), texts once by
    document.  A null or empty text has no chunks; an empty table gives an empty one; other columns are ignored.
    """
    found = Tables(docs.sparkSession, "chunks").write(chunk_spans(docs)).select(
        F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "spans"
    )
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("mark", F.hash(F.col("text")))
    joined = given.join(
        found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left"
    ).select(
        "doc_id",
        "text",
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
    )
    return joined.mapInArrow(_cut_out, "doc_id long, spans array<struct<start:int,stop:int>>, kept string")
