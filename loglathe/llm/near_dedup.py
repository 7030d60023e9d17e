"""MinHash near-duplicate removal: an LSH forest proposes families, full shingle sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.components import components
from loglathe.llm.tables import Tables
from loglathe.llm.words import shingle_sets, slices, text_bytes

#: Values that neighbours in a sorted order have to share at its start; each is for the families that the one before
#: left crowded, with as many orders as keep ``MISS``.
DEPTHS = (5, 7, 9)
#: Chance that a pair just at the threshold meets in no order.
MISS = 1e-6
#: Shingles of one block of a family that is compared at a time; a family that holds more is crowded.
BLOCK_SHINGLES = 250_000

_CHUNK = 512


def forest_size(share: float, depth: int) -> int:
    """Sorted orders needed so that a pair of that similarity is missed by all of them with chance ``MISS`` at most."""
    return math.ceil(math.log(MISS) / math.log(1 - share**depth))


def _signatures(sets: list[np.ndarray], values: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    factor = (rng.integers(0, 1 << 32, values, dtype=np.uint32) | np.uint32(1))[:, None]
    shift = rng.integers(0, 1 << 32, values, dtype=np.uint32)[:, None]
    out = np.empty((len(sets), values), np.uint32)
    room = np.empty((values, _CHUNK), np.uint32)
    for i, one in enumerate(sets):
        low = np.full(values, np.uint32(0xFFFFFFFF))
        short = (one >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), _CHUNK):
            piece = short[at : at + _CHUNK]
            held = room[:, : len(piece)]
            np.multiply(factor, piece[None, :], out=held)
            np.add(held, shift, out=held)
            np.minimum(low, held.min(axis=1), out=low)
        out[i] = low
    # 16 bits a value: the upper ones, spread by a multiplication because minima have zeros there
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _sketch(width: int, values: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            named = batch.select([c for c in batch.schema.names if c != "text"])
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                sets = shingle_sets(data[part[0] : part[-1]], part - part[0], width)
                marks = _signatures(sets, values, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        *named.slice(i, j - i).columns,
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([m.tobytes() if len(s) else None for s, m in zip(sets, marks)], pa.binary()),
                    ],
                    [*named.schema.names, "n_shingles", "set_key", "signature"],
                )

    return run


def _neighbours(width: int):
    """Links along a sorted order, and the partition's first and last row (with their key) for the seams.

    Rows that are next to each other and whose common prefix has the order's depth are linked, by way of the first row
    of their run; keys are as long as that depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_key = head_node = None
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw, _ = text_like(batch.column("key"), width)
            keys = np.ascontiguousarray(raw).view(f"V{width}").ravel()
            nodes = batch.column("node").to_numpy()
            fresh = np.empty(n, bool)
            fresh[1:] = keys[1:] != keys[:-1]
            fresh[0] = head_key is None or keys[0].tobytes() != head_key
            at = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            heads = np.where(at >= 0, nodes[at], head_node if head_node is not None else 0)
            linked = heads != nodes
            if last is None:
                yield _seam(nodes[0], keys[0].tobytes())
            if linked.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(heads[linked]), pa.array(nodes[linked]), pa.nulls(int(linked.sum()), pa.binary())],
                    ["a", "b", "prefix"],
                )
            head_key, head_node = keys[-1].tobytes(), heads[-1]
            last = (nodes[-1], head_key)
        if last is not None:
            yield _seam(*last)

    return run


def _tree_families(tables: Tables, signed: DataFrame, trees: int, depth: int) -> DataFrame:
    """``(node, root)`` of the rows that some sorted order of ``signed (node, family, signature)`` makes neighbours.

    Neighbours are of one ``family``; ``root`` is the smallest node of those that neighbours lead to.
    """
    orders = signed.select(
        "node", "family", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    ).select(
        F.expr(
            f"concat(unhex(lpad(hex(tree), 4, '0')), unhex(lpad(hex(family), 16, '0')),"
            f" substring(signature, tree * {2 * depth} + 1, {2 * depth}))"
        ).alias("key"),
        "node",
    )
    found = tables.write(
        orders.repartitionByRange("key", "node")
        .sortWithinPartitions("key", "node")
        .mapInArrow(_neighbours(10 + 2 * depth), "a long, b long, prefix binary")
    )
    seams = found.where("prefix IS NOT NULL").select("a", "prefix")
    heads = seams.groupBy("prefix").agg(F.min("a").alias("b"))
    candidates = found.where("b IS NOT NULL").select("a", "b").unionByName(seams.join(heads, "prefix").select("a", "b"))
    families = tables.write(components(tables, candidates))
    tables.drop(found)
    return families


def _families(tables: Tables, given: DataFrame, sets: DataFrame, width: int, share: float) -> DataFrame:
    """``(node, root, blocks)``: the families of the forest, and the blocks in which each is compared.

    Each family that is crowded at one depth is taken apart by the next, in orders of fresh values, as many as that
    depth needs.  What is crowded at the last depth stays whole.
    """
    signed = sets.select("node", F.lit(0).cast("long").alias("family"), "signature")
    ready = None
    for at, depth in enumerate(DEPTHS):
        trees = forest_size(share, depth)
        if at:
            texts = given.withColumnRenamed("doc_id", "node").join(crowded.select("node", "family"), "node")
            schema = "node long, family long, n_shingles long, set_key binary, signature binary"
            signed = texts.select("node", "family", "text").mapInArrow(
                _sketch(width, trees * depth, 11 + at), schema
            ).where("n_shingles > 0")
        families = _tree_families(tables, signed, trees, depth)
        weights = (
            sets.join(families, "node")
            .groupBy("root")
            .agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
        )
        weighed = tables.write(families.join(weights, "root").select("node", "root", "blocks"))
        if at + 1 < len(DEPTHS):
            crowded = weighed.where("blocks > 1").withColumnRenamed("root", "family")
            weighed = weighed.where("blocks = 1")
        ready = weighed if ready is None else ready.unionByName(weighed)
        if at + 1 < len(DEPTHS) and crowded.isEmpty():
            break
    return ready


def text_like(column: pa.Array, width: int) -> tuple[np.ndarray, int]:
    """A binary column of one width as a matrix of bytes."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(column), width), len(column)


def _seam(node: int, prefix: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([int(node)], pa.int64()), pa.nulls(1, pa.int64()), pa.array([prefix], pa.binary())], ["a", "b", "prefix"]
    )


def linked_roots(sets: list[np.ndarray], sides: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """For each set the index of its root, after linking all pairs with ``den * both >= num * either``.

    With ``sides`` only pairs of different sides are compared.  Exact: a pair can only be that similar if the second
    set holds one of the first ``n - ceil(n * num / den) + 1`` of the first one's shingles in any common order; rare
    shingles come first.  Pairs that are connected already are not compared again.
    """
    m = len(sets)
    root = np.arange(m)
    sizes = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ids = rank[ids]
    counts = np.sort(counts, kind="stable")
    present = np.zeros(len(counts), bool)
    postings: dict[int, list[int]] = {}
    sorted_ids = [np.sort(ids[bounds[i] : bounds[i + 1]]) for i in range(m)]
    for x in np.argsort(sizes, kind="stable"):
        mine, n = sorted_ids[x], int(sizes[x])
        head = mine[: n - (-(-n * num // den)) + 1]
        head = head[counts[head] > 1].tolist()
        met = [y for k in head for y in postings.get(k, ())]
        if met:
            near = np.unique(np.array(met, np.int64))
            near = near[(root[near] != root[x]) & (sizes[near] * den >= n * num)]
            if sides is not None:
                near = near[sides[near] != sides[x]]
            if len(near):
                present[mine] = True
                lengths = sizes[near]
                both = np.add.reduceat(
                    present[np.concatenate([sorted_ids[y] for y in near])].astype(np.int64),
                    np.concatenate([[0], np.cumsum(lengths)[:-1]]),
                )
                present[mine] = False
                for y in near[den * both >= num * (n + lengths - both)]:
                    if root[y] != root[x]:
                        old, new = max(root[y], root[x]), min(root[y], root[x])
                        root[root == old] = new
        for k in head:
            postings.setdefault(k, []).append(x)
    return root


def _compare(width: int, num: int, den: int):
    """Links within each family, or between two blocks of a large one; rows come sorted by family and block pair."""

    def links(texts: pa.ChunkedArray, nodes: np.ndarray, blocks: np.ndarray, crossed: bool):
        data, offsets = text_bytes(texts)
        sets = []
        for i, j in slices(offsets):
            part = offsets[i : j + 1]
            sets += shingle_sets(data[part[0] : part[-1]], part - part[0], width)
        root = linked_roots(sets, blocks if crossed else None, num, den)
        far = root != np.arange(len(root))
        return nodes[root[far]], nodes[far]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            a, b = links(table["text"], table["node"].to_numpy(), table["block"].to_numpy(), key[1] != key[2])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("family", "low", "high")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for i, j in zip([0, *change], [*change, batch.num_rows]):
                now = tuple(int(c[i]) for c in cols)
                if key is not None and now != key:
                    yield from close()
                    held = []
                key = now
                held.append(batch.slice(i, j - i))
        if held:
            yield from close()

    return run


def near_duplicates(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``den * |A and B| >= num * |A or B|`` for their sets of distinct ``width``-word shingles
    (A-Z lower-cased, words split at ASCII space; a text with fewer words is one shingle).  ``component_id`` is the
    smallest ``doc_id`` that links lead to, ``kept`` marks the document that has it.

    1. One pass over the texts makes each set's size, digest and MinHash signature.  Equal sets go on as one.
    2. The signatures are sorted in several orders, each by other values.  Neighbours in an order whose longest common
       prefix reaches the first of ``DEPTHS`` are candidates, and those that they connect form a family.
    3. Depth grows where it has to: the members of a family that holds more than ``BLOCK_SHINGLES`` get fresh, longer
       signatures and are sorted again, in more orders and to the next depth, which splits families that only chance or
       common passages hold together.  At every depth a pair at the threshold meets but for a chance of ``MISS``.
       A family's texts meet once, in blocks of bounded size (all pairs of blocks of what is crowded at the last depth),
       and links are decided on the full sets.
    4. Verified links give the components.

    Empty texts and nulls have no shingles and link with nothing.  Rows that share a ``doc_id`` are one document for the
    components.  Rows without ``doc_id`` keep no component and are kept.  Other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "near-dedup")
    values = forest_size(num / den, DEPTHS[0]) * DEPTHS[0]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = tables.write(
        given.mapInArrow(_sketch(width, values, 11), "doc_id long, n_shingles long, set_key binary, signature binary")
    )
    named = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = tables.write(
        named.groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")
        )
    )
    texts = given.where("doc_id IS NOT NULL AND text IS NOT NULL")
    families = _families(tables, texts, sets, width, num / den)
    members = (
        sets.select("node", "set_key")
        .join(families, "node")
        .select("node", "set_key", F.col("root").alias("family"), "blocks")
        .withColumn("block", F.expr("CAST(pmod(xxhash64(set_key, 5), blocks) AS INT)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    )
    compared = (
        members.join(texts.withColumnRenamed("doc_id", "node"), "node")
        .select(
            "family",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "block",
            "node",
            "text",
        )
        .repartition("family", "low", "high")
        .sortWithinPartitions("family", "low", "high")
        .mapInArrow(_compare(width, num, den), "a long, b long")
    )
    verified = tables.write(compared)
    copies = named.join(sets.select("set_key", "node"), "set_key").where("doc_id <> node").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b")
    )
    roots = components(tables, verified.unionByName(copies)).withColumnRenamed("node", "doc_id")
    return (
        sketches.select("doc_id", "n_shingles")
        .join(roots, "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("root", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("root", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )

