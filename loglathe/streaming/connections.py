"""Lines of open connections, held together by keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import decode, strip
from ..operators.framing import inner_lines, split_chunks

#: Setting that names the state store; timers and lists need the one that is named here.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LINES = "conn_id LONG, after_seq LONG, after_idx INT, line BINARY"
_ENDS = ("seq", "closes", "feeds", "head", "tail")
_PACKED = "conn_id LONG, seq ARRAY<LONG>, closes ARRAY<BOOLEAN>, feeds ARRAY<INT>, head ARRAY<BINARY>, tail ARRAY<BINARY>"
_Line = Row("conn_id", "after_seq", "after_idx", "line")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks that a connection has in an Arrow batch as one row of lists: handing a row to the state costs more than
    what is done with it there."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("conn_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        codes, rows = codes[order], batch.take(pa.array(order))
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = pa.array(np.append(starts, len(codes)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, rows.column(name)) for name in _ENDS]
        yield pa.RecordBatch.from_arrays([rows.column("conn_id").take(pa.array(starts)), *lists], ["conn_id", *_ENDS])


class _Connection(StatefulProcessor):
    """State of a connection: the line feed behind which its open line began, with the line's first piece, and the pieces
    that came later (all, before any line feed).

    Each call of the state is a round trip, and most connections come once per micro-batch with a few chunks: a line that is
    open over the end of one micro-batch costs one read and one write.  Later pieces are only added.
    """

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", "after_seq LONG, after_idx INT, first BINARY, goes_on BOOLEAN")
        self.pieces = handle.getListState("pieces", "piece BINARY")

    def _listed(self, held) -> list[bytes]:
        return [bytes(row[0]) for row in self.pieces.get()] if held is None or held[3] else []

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [row for some in rows for row in zip(*(some[name].tolist() for name in _ENDS))]
        out = self._taken(key, came, timerValues)
        if out:
            yield _frame(out)

    def _taken(self, key, came: list[tuple], timerValues) -> list[tuple]:
        """Lines that end with the chunks of a micro-batch, given in any order."""
        came.sort(key=lambda row: (pd.isna(row[0]), 0 if pd.isna(row[0]) else row[0], row[1]))
        held = self.began.get()
        began = None if held is None else tuple(held[:2])
        listed: list[bytes] = []
        new: list[bytes] = []
        out: list[tuple] = []
        earlier = True  # the open line began in an earlier micro-batch, and its pieces have not been read

        def end_line() -> None:
            nonlocal earlier, listed, new
            if earlier:
                listed = self._listed(held)
                new = [*([] if held is None else [bytes(held[2])]), *listed, *new]
            out.append((key[0], *(began or (None, 0)), b"".join(new)))
            earlier, new = False, []

        is_open = True
        for seq, closes, feeds, head, tail in came:
            is_open = not closes
            if closes:
                end_line()
                began = None
                continue
            new.append(bytes(head))
            if feeds:
                end_line()
                began, new = (int(seq), int(feeds)), [bytes(tail)]
        new = b"".join(new)
        if earlier:
            self._add(held, new)
        else:
            self._replace(held, listed, began, new)
        if self.idle_ms is not None:
            self._forget_timers()
            if is_open:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        return out

    def _add(self, held, new: bytes) -> None:
        if not new:
            return
        if held is not None and not held[3]:
            self.began.update((*held[:3], True))
        self.pieces.appendList([(new,)])

    def _replace(self, held, listed: list[bytes], began: tuple[int, int] | None, new: bytes) -> None:
        if listed:
            self.pieces.clear()
        if began is not None:
            self.began.update((*began, new, False))
            return
        if held is not None:
            self.began.clear()
        if new:
            self.pieces.appendList([(new,)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame([self._expired(key)])

    def _expired(self, key) -> tuple:
        held = self.began.get()
        listed = self._listed(held)
        after = (None, 0) if held is None else tuple(held[:2])
        self.began.clear()
        self.pieces.clear()
        return key[0], *after, b"".join([*([] if held is None else [bytes(held[2])]), *listed])


class _PackedConnection(_Connection):
    """The same for packed chunks, as rows: a data frame for the few of each connection costs more than the state does."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came: list[tuple] = []
        ends = None
        for row in rows:
            ends = ends or itemgetter(*map(row.__fields__.index, _ENDS))
            came.extend(zip(*ends(row)))
        for line in self._taken(key, came, timerValues):
            yield _Line(*line)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield _Line(*self._expired(key))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conn_id", "after_seq", "after_idx", "line"], dtype=object)


def frame_connections(
    chunks: DataFrame, idle_seconds: float | None = None, encoding: str = "utf-8", errors: str = "replace"
) -> DataFrame:
    """Lines of a stream of ``conn_id, seq, payload`` chunks, as a stream: ``conn_id, after_seq, after_idx, raw``.

    ``after_seq, after_idx`` name the line feed before the line, as in ``frame_chunks``.  A row whose payload is null
    closes its connection: what is open becomes a line, and nothing of the connection is kept; a chunk behind it begins
    a connection of the same name.  With ``idle_seconds``, connections that have sent nothing for so long are closed
    too; such a stream has micro-batches without chunks and needs a trigger by time, as ``availableNow`` would never end.
    An empty payload is a chunk without bytes.  Lines are stripped, blank
    ones dropped; repeated rows are repeated bytes.

    Chunks may come in any order within a micro-batch, but not across micro-batches.  Lines inside a chunk never leave
    the JVM; the first and last piece of each chunk go to the state of their connection, which holds the pieces of one
    open line and is only added to while that line goes on.  Outer pieces that one connection sends in one micro-batch
    meet in one task, which limits (``maxFilesPerTrigger`` and the like) bound; ``frame_chunk_stream`` spreads them.

    The session has to name ``STORE`` as its state store.
    """
    found = chunks.sparkSession.conf.get(STORE_SETTING, "")
    if not found.endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {STORE_SETTING} to {STORE}, found {found!r}")
    cut = split_chunks(chunks, "conn_id", "seq", "payload")
    ends = cut.select(
        F.col("conn_id").cast("long").alias("conn_id"),
        F.col("seq").cast("long").alias("seq"),
        F.col("pieces").isNull().alias("closes"),
        F.coalesce(F.size("pieces") - 1, F.lit(0)).alias("feeds"),
        F.encode(F.element_at("pieces", 1), "ISO-8859-1").alias("head"),
        F.encode(F.element_at("pieces", -1), "ISO-8859-1").alias("tail"),
    )
    idle_ms = None if idle_seconds is None else max(1, round(idle_seconds * 1000))
    outer = (
        ends.mapInArrow(_packed, _PACKED)
        .groupBy("conn_id")
        .transformWithState(
            _PackedConnection(idle_ms), _LINES, "append", "none" if idle_ms is None else "processingTime"
        )
        .select("conn_id", "after_seq", "after_idx", strip(decode(F.col("line"), encoding, errors)).alias("raw"))
    )
    return outer.unionByName(inner_lines(cut, encoding, errors)).where(F.col("raw") != "")
