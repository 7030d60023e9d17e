"""Removal of long byte strings that stand in an earlier document: sampled suffixes, sorted, named and compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.tables import Tables
from loglathe.llm.words import _LETTERS, _Powers, mix, slices, text_bytes

#: Bytes of a string that is removed if an earlier document has it.
LENGTH = 50
#: Bytes by which positions are sampled: of every string of ``LENGTH`` bytes the position whose gram is least.
GRAM = 20
_SPREAD = LENGTH - GRAM + 1  # grams in a string
_WIDEST = LENGTH + _SPREAD - 1  # bytes of the strings of one sampled position
#: Bytes that are sampled at a time, bytes of which the sampled positions are held, runs whose strings are.
SLICE = 1 << 17
PART_BYTES = 1 << 23
_TOGETHER = 1 << 12
#: Runs that are sorted and named at a time, whole grams.
_SORTED = 1 << 15


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Strings of ``LENGTH`` bytes, gathered by the sampled position that represents them.

    Every string is represented by the leftmost of its least grams.  That depends on the string alone, so equal strings
    have equal representatives at equal offsets, wherever they stand.  Strings that start next to one another mostly
    share theirs.  Returns for each such run: hash of the gram, hash of all its bytes and the gram's place in them, row,
    start in the row, number of strings.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    up, down = _Powers.of(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * up, out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    value = (grams >> np.uint64(32)).astype(np.uint32)
    place = np.arange(len(value), dtype=np.int32)
    width = 1
    while width < _SPREAD:  # least of a growing window: of this half and of the one that completes it
        step = min(width, _SPREAD - width)
        left, right = value[:-step], value[step:]
        later = right < left
        value = np.where(later, right, left)
        place = np.where(later, place[step:], place[:-step])
        width += step
    sizes = np.diff(offsets)
    valid = np.maximum(sizes - LENGTH + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), valid)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(valid) - valid, valid)
    starts = offsets[rows] + inside
    spots = place[starts]
    first = np.flatnonzero(np.concatenate([[True], spots[1:] != spots[:-1]]))
    count = np.diff(np.concatenate([first, [len(spots)]]))
    low = starts[first]
    high = low + count - 1 + LENGTH
    spot = spots[first].astype(np.int64)
    whole = mix((total[high] - total[low]) * down[low] + (spot - low).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return grams[spot], whole, rows[first], inside[first], count


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(
        b"".join((p if p.shape[1] > 8 else p.T).tobytes() for p in planes)
    )


def _spread_out(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        piece = raw[at : at + n * width]
        whole = piece.reshape(n, width) if width > 8 else np.ascontiguousarray(piece.reshape(width, n).T)
        out.append(whole if width > 8 else whole.view(kind).ravel())
        at += n * width
    return out


#: Columns of the tables between the steps: gram hash, document, tag of its text, start, number of strings; then spans.
_ENTRY = ("<u8", "<i8", "<u2", "<u4", "u1")
_SPAN = ("<i8", "<u2", "<u4", "<u4")
_BLOBS = "part int, kind int, blob binary"


def _blobs(part: np.ndarray, kind: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """One row for each part, of the arrays' rows that go there."""
    order = np.argsort(part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    pairs = list(zip(bounds[:-1], bounds[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(part[i]) for i, _ in pairs], pa.int32()),
            pa.array([kind] * len(pairs), pa.int32()),
            pa.array([_squeezed(*(a[i:j] for a in arrays)) for i, j in pairs], pa.binary()),
        ],
        ["part", "kind", "blob"],
    )


def _span_blobs(parts: int, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    return _blobs(doc % parts, 1, doc, tag.astype("<u2"), start.astype("<u4"), size.astype("<u4"))


def _gram_part(gram: np.ndarray, parts: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _later(name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows sorted by name and document: whether a smaller document has the name too."""
    fresh = np.concatenate([[True], name[1:] != name[:-1]])
    return doc > doc[np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))]


def _sample(parts: int):
    """Sampled positions, by gram.  Of equal ones in a batch the smallest document goes on, so copies are summed up."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        gram, whole, doc, tag, start, count = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(gram, kind="stable")
        gram, whole, doc, tag, start, count = (c[order] for c in (gram, whole, doc, tag, start, count))
        same = np.flatnonzero(np.concatenate([[False], gram[1:] == gram[:-1]]))
        twice = np.unique(np.concatenate([same, same - 1])) if len(same) else same
        again = np.zeros(len(gram), bool)
        if len(twice):
            sub = twice[np.lexsort((doc[twice], whole[twice], gram[twice]))]
            again[sub] = _later(whole[sub], doc[sub])
        if again.any():
            yield _span_blobs(parts, doc[again], tag[again], start[again], count[again] + LENGTH - 1)
        new = ~again
        yield _blobs(
            _gram_part(gram[new], parts).astype(np.int64),
            0,
            gram[new] >> np.uint64(16),
            doc[new],
            tag[new].astype("<u2"),
            start[new].astype("<u4"),
            count[new].astype("u1"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            for i, j in slices(offsets, SLICE):
                a, b = int(offsets[i]), int(offsets[j])
                # a longer text is cut; neighbours share the bytes that strings across the cut need
                for low in range(a, max(b - LENGTH + 1, a) + 1, SLICE) if j == i + 1 else [a]:
                    high = min(b, low + SLICE + LENGTH - 1) if j == i + 1 else b
                    edges = np.array([0, high - low]) if j == i + 1 else offsets[i : j + 1] - a
                    gram, whole, row, start, count = sampled(data[low:high], edges)
                    if len(gram):
                        held.append((gram, whole, ids[i + row], tags[i + row], start + (low - a if j == i + 1 else 0), count))
                    size += high - low
                if size >= PART_BYTES and held:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _by_part(step):
    """Applies ``step`` to the blobs of one part after the other; rows come sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for now, blob in zip(batch.column("part").to_pylist(), batch.column("blob")):
                if part is not None and now != part:
                    yield from step(held)
                    held = []
                part = now
                held.append(blob.as_py())  # copied only while its part is at work
        if held:
            yield from step(held)

    return run


def _read(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*(_spread_out(b, *kinds) for b in blobs))]


def _wanted(parts: int):
    """Sampled positions whose gram stands in two documents or more, sent to their documents."""

    def step(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        gram, doc, tag, start, count = _read(blobs, _ENTRY)
        order = np.argsort(gram, kind="stable")
        gram, doc, tag, start, count = (c[order] for c in (gram, doc, tag, start, count))
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(gram)]]))
        shared = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), sizes)
        if shared.any():
            yield _blobs(doc[shared] % parts, 2, *(c[shared] for c in (gram, doc, tag, start, count)))

    return step


def _rows_of(ids: np.ndarray, tags: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """For pairs of document and tag, the first row that has them."""
    held = np.rec.fromarrays([ids, tags.astype("<u2")], names="d,t")
    order = np.argsort(held, order=["d", "t"], kind="stable")
    asked = np.rec.fromarrays([doc, tag], names="d,t")
    distinct, which = np.unique(asked, return_inverse=True)
    return order[np.searchsorted(held[order], distinct)][which]


def _fetched(parts: int):
    def run(texts: pa.Table, requests: pa.Table) -> pa.Table:
        none = pa.table({"part": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        if not requests.num_rows:
            return none
        gram, doc, tag, start, count = _read(requests["blob"].to_pylist(), _ENTRY)
        data, offsets = text_bytes(texts["text"])
        row = _rows_of(texts["doc_id"].to_numpy(), texts["tag"].to_numpy(), doc, tag)
        padded = np.concatenate([data, np.zeros(_WIDEST, np.uint8)])
        content = padded[(offsets[row] + start)[:, None] + np.arange(_WIDEST)]
        content[np.arange(_WIDEST) >= (count.astype(np.int64) + LENGTH - 1)[:, None]] = 0
        order = np.argsort(gram, kind="stable")
        part = _gram_part(gram[order] << np.uint64(16), parts).astype(np.int64)
        out = _blobs(part, 3, *(c[order] for c in (gram, doc, tag, start, count, content)))
        return pa.Table.from_batches([out])

    return run


def _compared(parts: int):
    """The strings of each gram: equal runs by name, the others sorted string by string; neighbours are compared."""

    def step(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = _read(blobs, (*_ENTRY, f"V{_WIDEST}"))
        blobs.clear()
        order = np.argsort(columns[0], kind="stable")
        edges = columns[0][order]
        low = 0
        while low < len(order):
            high = int(np.searchsorted(edges, edges[min(low + _SORTED, len(edges)) - 1], "right"))
            yield from named(*(c[order[low:high]] for c in columns))
            low = high

    def named(gram, doc, tag, start, count, content) -> Iterator[pa.RecordBatch]:
        words = np.ascontiguousarray(np.pad(content, ((0, 0), (0, -_WIDEST % 8)))).view(">u8").astype(np.uint64)
        order = np.lexsort((doc, *words.T[::-1], count, gram))
        gram, doc, tag, start, count = (c[order] for c in (gram, doc, tag, start, count))
        content = content[order]
        words = words[order]
        fresh = np.concatenate(
            [[True], (gram[1:] != gram[:-1]) | (count[1:] != count[:-1]) | (words[1:] != words[:-1]).any(axis=1)]
        )
        name = np.cumsum(fresh)
        again = _later(name, doc)
        if again.any():
            yield _span_blobs(parts, doc[again], tag[again], start[again], count[again].astype(np.int64) + LENGTH - 1)
        # of grams with several names, each name's strings, once for each place in its smallest document
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        names = np.diff(np.concatenate([name[first], [name[-1] + 1]]))
        several = np.repeat(names > 1, np.diff(np.concatenate([first, [len(gram)]])))
        rest = np.flatnonzero(several & ~again)
        for at in range(0, len(rest), _TOGETHER):  # whole grams at a time
            low = np.searchsorted(gram[rest], gram[rest[at]], "left") if at else 0
            high = np.searchsorted(gram[rest], gram[rest[min(at + _TOGETHER, len(rest)) - 1]], "right")
            if at and low < at:
                low = np.searchsorted(gram[rest], gram[rest[at - 1]], "right")
            own = rest[low:high]
            if len(own):
                yield from strings(*(c[own] for c in (gram, doc, tag, start, count, content)))

    def strings(gram, doc, tag, start, count, content) -> Iterator[pa.RecordBatch]:
        n = count.astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        flat = content.ravel()
        own = flat[(row * _WIDEST + shift)[:, None] + np.arange(LENGTH)]
        words = np.ascontiguousarray(np.pad(own, ((0, 0), (0, -LENGTH % 8)))).view(">u8").astype(np.uint64)
        order = np.lexsort((doc[row], *words.T[::-1]))
        sorted_words = words[order]
        name = np.cumsum(np.concatenate([[True], (sorted_words[1:] != sorted_words[:-1]).any(axis=1)]))
        gone = np.zeros(len(row), bool)
        gone[order] = _later(name, doc[row][order])
        begins = gone & ~np.concatenate([[False], gone[:-1] & (row[1:] == row[:-1])])
        ends = gone & ~np.concatenate([gone[1:] & (row[1:] == row[:-1]), [False]])
        a, b = np.flatnonzero(begins), np.flatnonzero(ends)
        if len(a):
            r = row[a]
            yield _span_blobs(parts, doc[r], tag[r], start[r].astype(np.int64) + shift[a], b - a + LENGTH)

    return step


_RESULT = "doc_id long, spans array<struct<start:int,stop:int>>, kept binary"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _cut_out(texts: pa.Table, spans: pa.Table) -> pa.Table:
    data, offsets = text_bytes(texts["text"])
    ids, tags = texts["doc_id"].to_numpy(), texts["tag"].to_numpy()
    change = np.zeros(len(data) + 1, np.int32)
    main = _rows_of(ids, tags, ids, tags.astype("<u2")) if len(ids) else np.zeros(0, np.int64)
    if spans.num_rows and len(ids):
        doc, tag, start, size = _read(spans["blob"].to_pylist(), _SPAN)
        low = offsets[_rows_of(ids, tags, doc, tag)] + start
        np.add.at(change, low, 1)
        np.add.at(change, low + size, -1)
    gone = np.cumsum(change, out=change)[:-1] > 0
    removed, kept = [], []
    for r in main:
        a, b = offsets[r], offsets[r + 1]
        own = gone[a:b]
        edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
        removed.append(
            [{"start": int(x), "stop": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
        )
        kept.append(data[a:b][~own].tobytes())
    return pa.table({"doc_id": texts["doc_id"], "spans": pa.array(removed, _SPAN_TYPE), "kept": pa.array(kept, pa.binary())})


def _prime(n: int) -> int:
    """The first prime from ``n`` on."""
    n = max(n, 3) | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: ``doc_id, spans, kept``, the UTF-8 bytes that remain.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller ``doc_id``; all
    strings are judged on the input.  ``spans`` are the maximal removed runs, as byte ranges.

    1. Every string of ``LENGTH`` bytes is represented by one sampled position, chosen by the string alone, about one in
       15 positions.  Only hashes of the grams there are shuffled, equal runs of a batch as one.
    2. Grams of two documents or more are sent back to their documents, which answer with the run's bytes.
    3. Runs are sorted.  Equal ones share a name, which all but the smallest document lose.  Where a gram has several
       names, their strings are sorted one by one, and equal neighbours are judged in the same way.
    4. The spans meet their texts again; these are shuffled once for both meetings.

    A null or empty text has nothing to lose.  A null ``doc_id`` has no order: such rows neither lose nor take anything.
    Rows that share a ``doc_id`` don't take from each other, and each of them loses what it holds itself.  Other columns
    are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "repeats")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = _prime(4 * tasks)
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    named = given.where("doc_id IS NOT NULL")
    mark = F.xxhash64("text")
    unlike = named.groupBy("doc_id").agg((F.min(mark) != F.max(mark)).alias("unlike")).where("unlike").limit(1).count()
    # texts of one document are told apart by a tag, if there are any
    tagged = named.withColumn("tag", F.expr("CAST(pmod(xxhash64(text), 65536) AS INT)") if unlike else F.lit(0))

    def by_part(blobs: DataFrame) -> DataFrame:
        # a stated number, because merged partitions come to Python as one batch of all their blobs
        return blobs.repartition(tasks, "part").sortWithinPartitions("part")

    first = tables.write(tagged.mapInArrow(_sample(parts), _BLOBS))
    asked = tables.write(
        by_part(first.where("kind = 0")).mapInArrow(_by_part(_wanted(parts)), _BLOBS)
    )
    texts = tagged.withColumn("part", F.expr(f"CAST(pmod(doc_id, {parts}) AS INT)"))
    found = texts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_fetched(parts), _BLOBS)
    answers = by_part(found).mapInArrow(_by_part(_compared(parts)), _BLOBS)
    spans = answers.unionByName(first.where("kind = 1"))
    done = texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_cut_out, _RESULT)
    rest = given.where("doc_id IS NULL").select(
        "doc_id", F.array().cast("array<struct<start:int,stop:int>>").alias("spans"), F.col("text").cast("binary").alias("kept")
    )
    return done.unionByName(rest)
