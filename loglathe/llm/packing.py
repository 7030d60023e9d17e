"""Packing of tokenized documents into fixed-length sequences by cutting stock."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglathe.llm.cutting_stock import patterns
from loglathe.llm.tables import Tables
from loglathe.llm.tokens import encoder
from loglathe.llm.words import slices, text_bytes

#: Tokens by which lengths are counted: a piece takes the place of the next multiple.
STEP = 4
#: Pieces of one length that are numbered in one task.
RANKED_TOGETHER = 50_000
#: Bytes of text that are tokenized at a time.
TEXT_BYTES = 1 << 23

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cuts(length: int, size: int) -> list[tuple[int, int]]:
    """After every ``size`` tokens; a rest over half of that is cut at the half, so that what remains fits together."""
    whole = length - length % size
    ends = [*range(size, whole + 1, size), *([whole + size // 2] if length - whole > size // 2 else []), length]
    return [(a, b) for a, b in zip([0, *ends], ends) if b > a]


def _cut(path: str, size: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in slices(offsets, TEXT_BYTES):
                part = offsets[i : j + 1]
                flat, bounds = encode(data[part[0] : part[-1]], part - part[0])
                rows: list[tuple] = []
                for k in range(j - i):
                    tokens = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for at, end in _cuts(len(tokens), size):
                        piece = tokens[at:end]
                        rows.append((i + k, at, len(piece), zlib.crc32(piece), len(tokens), piece if keep_ids else None))
                row, start, length, crc, total, held = zip(*rows)
                columns = [ids.take(pa.array(row)), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array([h.astype(np.int64) for h in held], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and then ``end_id``, cut into pieces (see ``_cuts``): a row per piece, ``ids`` on request.

    A null or empty text has the one id ``end_id``.  Repeated rows are documents of their own.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_cut(path, size, end_id, keep_ids), _PIECES + (", ids array<long>" if keep_ids else ""))


def _placing(plan: list[tuple[int, dict[int, int]]]):
    """A function from a piece's kind and rank to its sequence and its place there; the plan is bounded by the kinds."""
    begins: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, content in plan:
        place = 0
        for kind, copies in sorted(content.items(), reverse=True):
            begins.setdefault(kind, []).append((ranks.get(kind, 0), copies, sequence, place))
            ranks[kind] = ranks.get(kind, 0) + times * copies
            place += copies
        sequence += times
    tables = {kind: np.array(rows, np.int64).T for kind, rows in begins.items()}

    @F.pandas_udf("sequence_id long, place long")
    def placed(kinds: pd.Series, positions: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(kinds)), np.int64)
        kind_values, rank_values = kinds.to_numpy(), positions.to_numpy()
        for kind in np.unique(kind_values):
            here = kind_values == kind
            first, copies, base, place = tables[int(kind)]
            at = np.searchsorted(first, rank_values[here], "right") - 1
            inside = rank_values[here] - first[at]
            out[0, here] = base[at] + inside // copies[at]
            out[1, here] = place[at] + inside % copies[at]
        return pd.DataFrame({"sequence_id": out[0], "place": out[1]})

    return placed


def pack(cut: DataFrame, *, size: int = 2048) -> DataFrame:
    """The rows of ``cut`` (see ``pieces``) with ``sequence_id`` and ``offset``: where each piece lies.

    Lengths are counted in steps of ``STEP`` tokens.  A linear program over that histogram, whose columns a knapsack
    prices, says which lengths share a sequence; it is as large as the number of steps, whatever the data.  Pieces of a
    length are ranked, a bounded number in each task, and rank ranges go to the patterns.  Offsets then follow from the
    true lengths in each sequence, without gaps.  Padding is at most ``STEP - 1`` tokens for each piece, besides what
    the patterns leave and the last sequences.  An empty table gives none.  ``cut`` is read twice: pass a written table.
    """
    kind = F.ceil(F.col("length") / STEP).cast("int")
    known = cut.withColumn("kind", kind)
    counts = known.groupBy("kind").count().collect()  # one row per length step
    demand = [0] * -(-size // STEP)
    for row in counts:
        demand[row["kind"] - 1] = row["count"]
    salts = max(1, -(-max(demand) // RANKED_TOGETHER))
    order = ["doc_id", "start", "ids_crc32"]
    salted = known.withColumn("salt", F.expr(f"CAST(pmod(xxhash64({', '.join(order)}), {salts}) AS INT)"))
    before = (
        salted.groupBy("kind", "salt")
        .count()
        .select(
            "kind",
            "salt",
            (F.sum("count").over(Window.partitionBy("kind").orderBy("salt")) - F.col("count")).alias("before"),
        )
    )
    ranked = (
        salted.withColumn("within", F.row_number().over(Window.partitionBy("kind", "salt").orderBy(*order)) - 1)
        .join(before, ["kind", "salt"])
        .withColumn("placed", _placing(patterns(demand, len(demand)))(F.col("kind"), F.col("before") + F.col("within")))
        .select(*cut.columns, F.col("placed.sequence_id").alias("sequence_id"), F.col("placed.place").alias("place"))
    )
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("place")


def pack_documents(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """``pieces`` of all documents with their places, see ``pack``.  Texts are tokenized once; the pieces are written."""
    cut = Tables(docs.sparkSession, "packing").write(pieces(docs, path, size=size, end_id=end_id, keep_ids=keep_ids))
    return pack(cut, size=size)
