"""Lines from captured network payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import decode, strip

# Chunk numbers per block of the two-level running maximum in frame_chunks.
BLOCK_CHUNKS = 65536


def frame_datagrams(
    datagrams: DataFrame, payload: str = "payload", encoding: str = "utf-8", errors: str = "replace"
) -> DataFrame:
    """One record per datagram in ``raw``: line feeds at the end are removed, empty records dropped.

    A datagram with inner line feeds stays one record.
    """
    text = F.rtrim(decode(F.col(payload), encoding, errors), F.lit("\n"))
    return datagrams.withColumn("raw", text).where(F.col("raw") != "").drop(payload)


def _to_line(parts: Column, encoding: str, errors: str) -> Column:
    """Byte-per-character text back to bytes, decoded and stripped."""
    return strip(decode(F.encode(parts, "ISO-8859-1"), encoding, errors))


def split_chunks(chunks: DataFrame, conn: str, seq: str, payload: str) -> DataFrame:
    """Cut every chunk at line feeds: ``pieces`` holds the parts, as text with one character per byte."""
    text = F.decode(F.col(payload), "ISO-8859-1")
    return chunks.select(
        F.col(conn).alias("conn_id"), F.col(seq).alias("seq"), F.split(text, "\n").alias("pieces")
    )


def inner_lines(cut: DataFrame, encoding: str, errors: str) -> DataFrame:
    """Lines that begin and end inside one chunk of ``split_chunks``, by projections alone."""
    count = F.size("pieces")
    return (
        cut.where(count > 2)
        .select(
            "conn_id",
            F.col("seq").alias("after_seq"),
            F.posexplode(F.slice("pieces", F.lit(2), count - 2)).alias("_pos", "_piece"),
        )
        .select(
            "conn_id",
            "after_seq",
            (F.col("_pos") + 1).alias("after_idx"),
            _to_line(F.col("_piece"), encoding, errors).alias("raw"),
        )
    )


def chunk_anchors(cut: DataFrame, block: int = BLOCK_CHUNKS) -> DataFrame:
    """Add ``anchor``: the last earlier chunk of the connection that holds a line feed, null when there is none.

    A running maximum over a whole connection would be one task per connection.  Here it runs per block of chunk
    numbers, and a second one over one row per block carries the value into the next blocks.
    """
    feed = F.when(F.size("pieces") > 1, F.col("seq"))
    blocked = cut.withColumns({"_block": F.col("seq") - F.pmod("seq", F.lit(block)), "_feed": feed})
    before = Window.partitionBy("conn_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy("conn_id", "_block")
        .agg(F.max("_feed").alias("_last"))
        .withColumn("_carried", F.max("_last").over(before))
        .drop("_last")
    )
    inside = Window.partitionBy("conn_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocked.withColumn("_inside", F.max("_feed").over(inside))
        .join(carried, ["conn_id", "_block"])
        .withColumn("anchor", F.coalesce("_inside", "_carried"))
        .drop("_block", "_feed", "_inside", "_carried")
    )


def frame_chunks(
    chunks: DataFrame,
    conn: str = "conn_id",
    seq: str = "seq",
    payload: str = "payload",
    encoding: str = "utf-8",
    errors: str = "replace",
    block: int = BLOCK_CHUNKS,
    keep_open: bool = False,
) -> DataFrame:
    """Lines of each connection from its numbered chunks: ``conn_id, after_seq, after_idx, raw``.

    ``after_seq, after_idx`` name the line feed before the line (chunk, and position among the line feeds of that
    chunk; null and 0 for the first line), which orders the lines of a connection.  Lines are stripped and blank
    lines dropped; a tail without a line feed is a line too.

    Lines that begin and end inside one chunk, nearly all of them, leave in the first projection without a shuffle.
    Only the first and last piece of each chunk is shuffled, and they meet in groups that each hold one line.

    With ``keep_open`` the unterminated tail of each connection is returned too, as a row whose ``open`` is true
    and whose ``tail`` holds the bytes, for the next batch of the same connections.
    """
    cut = split_chunks(chunks, conn, seq, payload)
    count = F.size("pieces")
    inner = inner_lines(cut, encoding, errors)
    ends = cut.select(
        "conn_id",
        "seq",
        # Only the size and the outer pieces of the array are shuffled.
        F.when(count > 1, F.array(F.element_at("pieces", 1), F.element_at("pieces", -1)))
        .otherwise(F.col("pieces"))
        .alias("pieces"),
        count.alias("_count"),
    )
    anchored = chunk_anchors(ends, block)
    head = F.struct(
        F.col("anchor").alias("after_seq"),
        F.element_at("pieces", 1).alias("piece"),
        (F.col("_count") > 1).alias("closed"),
    )
    tail = F.struct(
        F.col("seq").alias("after_seq"), F.element_at("pieces", -1).alias("piece"), F.lit(False).alias("closed")
    )
    outer_parts = F.when(F.col("_count") > 1, F.array(head, tail)).otherwise(F.array(head))
    parts = anchored.select("conn_id", "seq", "_count", F.explode(outer_parts).alias("p")).select(
        "conn_id", "seq", "_count", "p.*"
    )
    joined = (
        parts.groupBy("conn_id", "after_seq")
        .agg(
            F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("_parts"),
            F.max("closed").alias("_closed"),
            # The feed before the line is the last one of its chunk; only that chunk's own tail knows its number.
            F.max(F.when(F.col("seq") == F.col("after_seq"), F.col("_count") - 1)).alias("_idx"),
        )
        .withColumn("_bytes", F.array_join(F.transform("_parts", lambda p: p["piece"]), ""))
    )
    outer = joined.select(
        "conn_id",
        "after_seq",
        F.coalesce("_idx", F.lit(0)).alias("after_idx"),
        _to_line(F.col("_bytes"), encoding, errors).alias("raw"),
        *([(~F.col("_closed")).alias("open"), F.encode("_bytes", "ISO-8859-1").alias("tail")] if keep_open else []),
    )
    if keep_open:
        inner = inner.withColumns({"open": F.lit(False), "tail": F.lit(None).cast("binary")})
        ends = outer.withColumn("tail", F.when(F.col("open"), F.col("tail")))
        return ends.unionByName(inner).where((F.col("raw") != "") | F.col("open"))
    return outer.unionByName(inner).where(F.col("raw") != "")
