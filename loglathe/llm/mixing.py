"""Mixing of sources to target weights, by fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm.tables import Tables, set_apart
from loglathe.llm.words import _SPACE, slices, text_bytes

#: Words of a block; the last block of a stream may hold fewer.
BLOCK_WORDS = 128
#: Blocks of an output shard.
SHARD_BLOCKS = 4096
#: Documents that are laid end to end in one stream; a larger source has several streams.
STREAM_DOCS = 4096
#: Sources that a mixture may have.  Their sizes and targets are the only rows that the driver sees.
MAX_SOURCES = 100_000
#: Passes over a source at most.
MAX_PASSES = 3


def source_targets(sizes: list[int], weights: list[float], most: float = MAX_PASSES) -> list[float]:
    """Shares of the whole by weight; a source stops at ``most`` times its size and the others share the excess."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(t for i, t in enumerate(targets) if i not in open_)
        scale = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / scale > most * sizes[i]}
        if not above:
            for i in open_:
                targets[i] = left * weights[i] / scale
            break
        for i in above:
            targets[i] = float(most * sizes[i])
        open_ -= above
    return targets


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        sizes = np.zeros(batch.num_rows, np.int64)
        for i, j in slices(offsets, 1 << 22):
            part = offsets[i : j + 1] - offsets[i]
            inside = ~_SPACE[data[offsets[i] : offsets[j]]]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            begins[part[part < len(inside)]] = inside[part[part < len(inside)]]
            total = np.concatenate([[0], np.cumsum(begins)])
            sizes[i:j] = np.diff(total[part])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), batch.column("mark"), pa.array(sizes)],
            ["doc_id", "source", "mark", "size"],
        )


def _draws(amounts: np.ndarray, slots: int, seed: int):
    """For a shard, how many of its slots each source gets: its whole share, and multinomial draws of what remains."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = amounts / amounts.sum()
        for batch in batches:
            for shard in batch["id"]:
                size = min(SHARD_BLOCKS, slots - shard * SHARD_BLOCKS)
                counts = np.floor(scale * size + 1e-9).astype(np.int64)
                rest = size - int(counts.sum())
                if rest > 0:
                    part = np.maximum(scale * size - counts, 0)
                    counts += np.random.default_rng([seed, shard]).multinomial(rest, part / part.sum())
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "src": used, "n": counts[used]})

    return run


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of ``0 .. size - 1``: a Feistel network on the next even number of bits, walked into range."""
    half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) // 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            x = (right + k + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            left, right = right, left ^ (x & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _laid_out(docs: DataFrame, tables: Tables, weights, seed: int):
    """Documents with their place in their source's blocks, how often each block is drawn, and the sources' figures."""
    spark = docs.sparkSession
    sized = tables.write(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.col("text").cast("string").alias("text"),
            F.xxhash64(F.col("text").cast("string")).alias("mark"),
        ).mapInArrow(_count_words, "doc_id long, source string, mark long, size long")
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    given = [weights(i, r["source"]) for i, r in enumerate(found)]
    targets = source_targets(sizes, given)
    rows = [
        (i, r["source"], r["size"], targets[i], -(-r["docs"] // STREAM_DOCS)) for i, r in enumerate(found)
    ]
    sources = spark.createDataFrame(rows, "src long, name string, source_size long, target double, streams long")
    in_stream = Window.partitionBy("src", "stream").orderBy("doc_id", "mark", "size")
    placed = tables.write(
        sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")))  # MAX_SOURCES rows at most
        .withColumn("stream", F.expr("pmod(xxhash64(doc_id, mark), streams)"))
        .withColumn("nth", F.row_number().over(in_stream))
        .withColumn("start", F.sum("size").over(in_stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .select("src", "stream", "nth", "doc_id", "mark", "size", "source_size", "target", "start")
    )
    streams = (
        placed.groupBy("src", "stream")
        .agg(F.ceil(F.sum("size") / F.lit(BLOCK_WORDS)).alias("blocks"))
        .withColumn("base", F.sum("blocks").over(Window.partitionBy("src").orderBy("stream")) - F.col("blocks"))
    )
    blocks = np.zeros(len(rows), np.int64)
    for r in streams.groupBy("src").agg(F.sum("blocks").alias("blocks")).collect():  # a row per source
        blocks[r["src"]] = r["blocks"]
    amounts = np.array([t / s * b if s else 0.0 for t, s, b in zip(targets, sizes, blocks)])
    slots = round(float(amounts.sum()))
    pieces = (
        placed.where("size > 0")
        .join(streams.select("src", "stream", "base"), ["src", "stream"])
        .withColumn("k", F.explode(F.expr(f"sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS})")))
        .select(
            "src",
            (F.col("base") + F.col("k")).alias("block"),
            "stream",
            "nth",
            F.expr(f"greatest(start, k * {BLOCK_WORDS}) - start").alias("low"),
            F.expr(f"least(start + size, (k + 1) * {BLOCK_WORDS}) - start").alias("high"),
        )
    )

    @F.pandas_udf("long")
    def block_of(src: pd.Series, slot: pd.Series) -> pd.Series:
        s, k = src.to_numpy(), slot.to_numpy()
        n = blocks[s]
        return pd.Series(permuted(k % n, n, (seed * 1_000_003 + s) * 1_000_003 + k // n))

    counts = spark.range(0, -(-slots // SHARD_BLOCKS)).mapInPandas(
        _draws(amounts, slots, seed), "shard long, src long, n long"
    ) if slots else spark.createDataFrame([], "shard long, src long, n long")
    most = spark.createDataFrame([(i, int(b) * MAX_PASSES) for i, b in enumerate(blocks)], "src long, most long")
    drawn = (
        counts.withColumn("first", F.sum("n").over(Window.partitionBy("src").orderBy("shard")) - F.col("n"))
        .join(F.broadcast(most), "src")  # a row per source
        .withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
        .where("slot < most")
        .select("src", block_of("src", "slot").alias("block"))
        .groupBy("src", "block")
        .agg(F.count("*").alias("times"))
    )
    return placed, pieces.join(drawn, ["src", "block"])


def _by_turns(i: int, _: str | None) -> float:
    return float(i % 3 + 1)


def mix(docs: DataFrame, *, weights=_by_turns, seed: int = 17) -> DataFrame:
    """One row per row of ``docs (doc_id, text, source, ...)``: ``doc_id, size, source_size, target, taken``.

    ``size`` is the number of words ``[^\\x20\\x09-\\x0D]+``, ``target`` the words that the mix should take from the
    document's source (see ``source_targets``; ``weights(i, source)`` for the i-th source by code point, null last),
    ``taken`` the words that it takes from the document, repeats counted.

    Documents lie end to end in streams of their source (a hot source has many) that are cut into blocks of
    ``BLOCK_WORDS`` words.  Each output shard draws how many of its slots every source fills: the whole part of its
    share, and multinomially what remains, so that sources stay within a few blocks of their target.  The slots of a
    source are numbered on through all shards; slot ``k`` takes the block that a keyed permutation of the source's
    blocks, another one for each pass, has at ``k``.  Blocks and slots are joined by index.  No block is taken more
    than ``MAX_PASSES`` times.

    Only the table of sources reaches the driver.  A null text has no words, a null source is a source, a null
    ``doc_id`` is kept, repeated rows are rows of their own, and an empty table gives an empty one.
    """
    placed, drawn = _laid_out(docs, Tables(docs.sparkSession, "mixing"), weights, seed)
    taken = (
        drawn.groupBy("src", "stream", "nth").agg(F.sum((F.col("high") - F.col("low")) * F.col("times")).alias("taken"))
    )
    return placed.join(taken, ["src", "stream", "nth"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, texts = [], []
        data, offsets = text_bytes(batch.column("text"))
        held = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            whole = max(s["size"] for s in spans)
            raw = data[offsets[i] : offsets[i + 1]]
            inside = ~_SPACE[raw]
            edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for turn in range(MAX_PASSES):
                for nth in sorted({s["nth"] for s in spans}):
                    own = sorted((s["low"], s["high"]) for s in spans if s["nth"] == nth and s["times"] > turn)
                    merged: list[list[int]] = []
                    for low, high in own:
                        if merged and merged[-1][1] == low:
                            merged[-1][1] = high
                        else:
                            merged.append([low, high])
                    if merged:
                        row.append(i)
                        texts.append(
                            held[i]
                            if merged == [[0, whole]]
                            else "\n".join(raw[begins[a] : ends[b - 1]].tobytes().decode() for a, b in merged)
                        )
        if row:
            kept = batch.select([n for n in batch.schema.names if n not in ("text", "spans")]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(texts, pa.string())], [*kept.schema.names, "text"]
            )


def mixed_documents(docs: DataFrame, *, weights=_by_turns, seed: int = 17) -> DataFrame:
    """The mix itself, in the columns of ``docs``: for every pass over a document, the text that the pass takes of it.

    A pass that takes all its blocks gives the text as it is, another one the taken stretches, joined by line breaks.
    Documents without words are in no mix.  Other columns are copied, whatever their names; ``n_chars``, if there, is
    counted anew.
    """
    packed, back = set_apart(docs, ("doc_id", "text", "source", "n_chars"))
    return back(_mixed(packed, weights, seed))


def _mixed(docs: DataFrame, weights, seed: int) -> DataFrame:
    tables = Tables(docs.sparkSession, "mixing")
    placed, drawn = _laid_out(docs, tables, weights, seed)
    key = ["src", "stream", "nth"]
    spans = (
        drawn.join(placed.select(*key, "doc_id", "mark", "size"), key)
        .groupBy("doc_id", "mark")
        .agg(F.collect_list(F.struct("nth", "low", "high", "times", "size")).alias("spans"))
        .select(F.col("doc_id").alias("mix_doc"), F.col("mark").alias("mix_mark"), "spans")
    )
    rest = [c for c in docs.columns if c != "text"]
    one = docs.withColumn("mix_mark", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "mix_mark"])
    joined = one.join(
        spans, F.col("doc_id").cast("long").eqNullSafe(F.col("mix_doc")) & (one["mix_mark"] == spans["mix_mark"])
    ).select(*rest, "text", "spans")
    kinds = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in rest] + [T.StructField("text", T.StringType())])
    out = joined.mapInArrow(_fragments, kinds)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)
