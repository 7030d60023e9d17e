"""Conversations as a trie of their turns: shards of sorted paths, and a small skeleton of the paths between shards."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm.tables import Tables

#: Bytes of a turn in a path: 16 of its digest, then the length of its text.
HASH_BYTES, LENGTH_BYTES = 16, 4
TURN_BYTES = HASH_BYTES + LENGTH_BYTES
#: Bytes of paths that a shard should have, and what a path counts besides its turns.
SHARD_BYTES, ROW_BYTES = 256 << 10, 40
#: Turns of a splitter at most, and of all splitters together: the size of the skeleton, which is broadcast.
SPLITTER_TURNS, SKELETON_TURNS = 1024, 1_000_000
#: Bytes of ids in a row of the ends of a skeleton node.
END_BYTES = 1 << 20

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_key(role: Column, text: Column) -> Column:
    """A turn as ``2 * TURN_BYTES`` hex digits; turns with equal role and text, and no others, have equal keys."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    length = F.lpad(F.lower(F.hex(F.octet_length(text))), 2 * LENGTH_BYTES, "0")
    return F.concat(F.substring(digest, 1, 2 * HASH_BYTES), length)


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the keys of each conversation's turns by turn, null first; rows without conv_id are left out.

    Turns of one number stand in the order of their keys.
    """
    keyed = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            F.col("turn").alias("turn"),
            turn_key(F.col("role"), F.col("text")).alias("key"),
        ).alias("turn"),
    )
    gathered = keyed.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("turns"))


def rebuilt(whole: DataFrame, group: int, most: int) -> DataFrame:
    """Each conversation c of ``turns`` with the first h turns of conversation c - c % ``group`` in place of its own first
    h; h is crc32 of c's digits modulo ``most``.  Shorter ones lend all they have, absent ones none."""
    c = F.col("conv_id")
    base, h = (c - c % group).alias("base"), F.crc32(c.cast("string").cast("binary")) % most
    heads = whole.where(c % group == 0).select(c.alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = whole.select("conv_id", base, h.cast("int").alias("h"), "turns")
    lent = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    kept = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(lent, kept).alias("turns"))


def paths(sequences: DataFrame) -> DataFrame:
    """``conv_id, path``: the keys of all turns as bytes, one after the other; prefixes of paths are paths of prefixes."""
    return sequences.select("conv_id", F.unhex(F.array_join("turns", "")).alias("path"))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with in common."""
    low, high = 0, min(len(a), len(b)) // TURN_BYTES
    if a[: high * TURN_BYTES] == b[: high * TURN_BYTES]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * TURN_BYTES : middle * TURN_BYTES] == b[low * TURN_BYTES : middle * TURN_BYTES]:
            low = middle
        else:
            high = middle
    return low


@dataclass
class Skeleton:
    """Splitters in order, and the nodes on their paths; node 0 is the root.

    ``nodes[k][d]`` is the node at depth d on splitter k's path; ``parent`` and ``depth`` are by node, parents first.
    """

    splitters: list[tuple[bytes, int]]
    nodes: list[np.ndarray]
    parent: list[int]
    depth: list[int]

    @classmethod
    def of(cls, splitters: list[tuple[bytes, int]]) -> Skeleton:
        nodes, parent, depth, before = [], [-1], [0], b""
        for path, _ in splitters:
            size = len(path) // TURN_BYTES
            common = _shared(before, path)
            first = len(parent)
            way = np.concatenate(
                [nodes[-1][: common + 1] if nodes else np.zeros(1, np.int64), np.arange(first, first + size - common)]
            ).astype(np.int64)
            parent += way[common:-1].tolist()
            depth += range(common + 1, size + 1)
            nodes.append(way)
            before = path
        return cls(splitters, nodes, parent, depth)


def _splitters(table: DataFrame) -> list[tuple[bytes, int]]:
    """Keys that cut the table, sorted by path and id, into shards of ``SHARD_BYTES`` on average.

    Rows are drawn in proportion to their size, so the bytes between two of them are like waiting times: of a million
    shards, the largest has some 14 times the average.  Equal paths are cut by id.  Where the paths of all splitters
    would exceed ``SKELETON_TURNS``, there are fewer of them.
    """
    weight = F.octet_length("path") + ROW_BYTES
    total = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    shards = total // SHARD_BYTES + 1
    if shards == 1:
        return []
    share = F.pmod(F.xxhash64("conv_id", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    longest = SPLITTER_TURNS * TURN_BYTES
    # a cut path stands for the place before all that go on from it
    own_id = F.when(F.octet_length("path") <= longest, F.col("conv_id")).otherwise(F.lit(-(1 << 63)))
    drawn = table.where(share < weight * (shards / total))
    chosen = drawn.select(F.substring("path", 1, longest).alias("path"), own_id.alias("id")).distinct()
    turns_of_all = chosen.agg(F.sum(F.octet_length("path") / TURN_BYTES + 1).alias("n")).first()["n"] or 0
    step = int(turns_of_all // SKELETON_TURNS) + 1
    if step > 1:
        chosen = chosen.where(F.pmod(F.xxhash64("path", "id"), F.lit(step)) == 0)
    return sorted((bytes(r["path"]), r["id"]) for r in chosen.collect())


class _Nodes:
    """The nodes of one shard's sorted paths, in order of first visit."""

    def __init__(self, rows: list[bytes], ids: list[int], low: bytes | None, high: bytes | None) -> None:
        parent, depth, sizes, at, before = [-1], [0], [0], [0], b""
        ends = np.empty(len(rows), np.int64)
        for r, path in enumerate(rows):
            if path != before:
                common, size = _shared(before, path), len(path) // TURN_BYTES
                new = list(range(len(parent), len(parent) + size - common))
                at = at[: common + 1]
                parent += [at[common], *new[:-1]] if new else []
                at += new
                depth += range(common + 1, size + 1)
                units = np.frombuffer(path, np.uint8).reshape(size, TURN_BYTES)[common:, HASH_BYTES:]
                sizes += np.ascontiguousarray(units).view(">u4").ravel().tolist()
                before = path
            ends[r] = at[-1]
        self.parent, self.depth = np.array(parent), np.array(depth)
        self.sizes, self.ends, self.ids = np.array(sizes, np.int64), ends, np.array(ids, np.int64)
        first = self._way(ends[0])
        last = self._way(ends[-1])
        on_low = first[: _shared(rows[0], low) + 1] if low is not None else first[:1]
        on_high = last[: _shared(rows[-1], high) + 1] if high is not None else last[:1]
        self.on_low, self.on_high = on_low, on_high
        self.open = np.zeros(len(parent), bool)
        self.open[[*on_low, *on_high]] = True
        self._add_up()

    def _way(self, node: int) -> list[int]:
        out = [int(node)]
        while out[-1]:
            out.append(int(self.parent[out[-1]]))
        return out[::-1]

    def _add_up(self) -> None:
        """Aggregates from the deepest nodes up; open nodes give nothing to their parents, which are open too."""
        n = len(self.parent)
        self.members, self.least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        np.add.at(self.members, self.ends, 1)
        np.minimum.at(self.least, self.ends, self.ids)
        self.children, self.leaves, self.saved = (np.zeros(n, np.int64) for _ in range(3))
        by_depth = np.argsort(self.depth, kind="stable")
        bounds = np.searchsorted(self.depth[by_depth], np.arange(self.depth.max() + 2))
        for d in range(int(self.depth.max()), 0, -1):
            level = by_depth[bounds[d] : bounds[d + 1]]
            level = level[~self.open[level]]
            up = self.parent[level]
            self.leaves[level] += self.children[level] == 0
            self.saved[level] += (self.members[level] - 1) * self.sizes[level]
            np.add.at(self.children, up, 1)
            for values in (self.members, self.leaves, self.saved):
                np.add.at(values, up, values[level])
            np.minimum.at(self.least, up, self.least[level])


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


_FINISHED = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in COLUMNS[:-1]),
        T.StructField("ends_sha256", T.StringType()),
        T.StructField("skeleton", T.LongType()),
        T.StructField("ends", T.BinaryType()),
    ]
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _finish(nodes: _Nodes, low: np.ndarray | None, high: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of a shard.  Closed nodes are whole; ``skeleton`` is set where the parent is open, to find its id later.

    Open nodes are parts: ``skeleton`` is their own number and ``depth`` is null.  Their ends are rows with nothing else
    but the smallest id in them.
    """
    number = np.full(len(nodes.parent), -1, np.int64)
    for on, way in ((nodes.on_low, low), (nodes.on_high, high)):
        number[on] = way[: len(on)] if way is not None else 0
    order = np.argsort(nodes.ends, kind="stable")  # ids stay in their order
    bounds = np.searchsorted(nodes.ends[order], np.arange(len(nodes.parent) + 1))
    closed = np.flatnonzero(~nodes.open)
    digest = [
        hashlib.sha256(_joined(nodes.ids[order[bounds[k] : bounds[k + 1]]])).hexdigest() if bounds[k + 1] > bounds[k] else _NO_ENDS
        for k in closed
    ]
    opened = np.flatnonzero(nodes.open)

    def batch(some: np.ndarray, **own) -> pa.RecordBatch:
        none = pa.nulls(len(some), pa.int64())
        columns = {
            "conv_id": pa.array(nodes.least[some]),
            "depth": none,
            "parent_conv_id": none,
            "n_convs": pa.array(nodes.members[some]),
            "n_children": pa.array(nodes.children[some]),
            "n_leaves": pa.array(nodes.leaves[some]),
            "saved_tokens": pa.array(nodes.saved[some]),
            "ends_sha256": pa.nulls(len(some), pa.string()),
            "skeleton": none,
            "ends": pa.nulls(len(some), pa.binary()),
        } | own
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    if len(closed):
        up = nodes.parent[closed]
        below = nodes.open[up]
        yield batch(
            closed,
            depth=pa.array(nodes.depth[closed]),
            parent_conv_id=pa.array(nodes.least[up], mask=below),
            ends_sha256=pa.array(digest),
            skeleton=pa.array(number[up], mask=~below),
        )
    # an open node without own members has no smallest id yet
    empty = nodes.members[opened] == 0
    yield batch(opened, conv_id=pa.array(nodes.least[opened], mask=empty), skeleton=pa.array(number[opened]))
    for k in opened:
        ids = nodes.ids[order[bounds[k] : bounds[k + 1]]]
        step = END_BYTES // 20
        for at in range(0, len(ids), step):
            some = np.array([k])
            none = pa.nulls(1, pa.int64())
            yield batch(
                some,
                conv_id=pa.array(ids[at : at + 1]),
                n_convs=none,
                n_children=none,
                n_leaves=none,
                saved_tokens=none,
                skeleton=pa.array(number[some]),
                ends=pa.array([_joined(ids[at : at + step])], pa.binary()),
            )


def _placed(skeleton):
    """Shard of each path: the number of splitters up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = skeleton.value.splitters
        for batch in batches:
            pairs = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = pa.array([bisect_right(keys, pair) for pair in pairs], pa.int32())
            yield pa.RecordBatch.from_arrays([shard, batch.column("path"), batch.column("conv_id")], ["shard", "path", "conv_id"])

    return run


def _finished(skeleton):
    """Nodes of the shards of a task, one shard in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, held, rows, ids = skeleton.value, None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            low, high = held - 1, held
            has_low, has_high = low >= 0, high < len(whole.splitters)
            nodes = _Nodes(
                rows, ids, whole.splitters[low][0] if has_low else None, whole.splitters[high][0] if has_high else None
            )
            return _finish(nodes, whole.nodes[low] if has_low else None, whole.nodes[high] if has_high else None)

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held is not None and shards[a] != held:
                    yield from close()
                    rows, ids = [], []
                held = int(shards[a])
                rows += batch.column("path").slice(a, b - a).to_pylist()
                ids += batch.column("conv_id").slice(a, b - a).to_pylist()
        if held is not None:
            yield from close()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ends of each skeleton node, whose rows come one after the other in the order of ids."""
    held, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([digest.hexdigest()])], ["skeleton", "digest"])

    for batch in batches:
        for node, ends in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
            if node != held:
                if held is not None:
                    yield row()
                held, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends)
    if held is not None:
        yield row()


def _skeleton_rows(spark: SparkSession, skeleton: Skeleton, parts: DataFrame) -> DataFrame:
    """Whole rows of the skeleton's nodes from their parts: sums over shards, then up the skeleton."""
    n = len(skeleton.parent)
    sums = parts.where("depth IS NULL AND ends IS NULL").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    least = [None] * n
    members, children, leaves, saved = ([0] * n for _ in range(4))
    for r in sums.collect():
        k = r["skeleton"]
        least[k], members[k], children[k] = r["conv_id"], r["n_convs"], r["n_children"]
        leaves[k], saved[k] = r["n_leaves"], r["saved_tokens"]
    size = [0] * n
    for (path, _), way in zip(skeleton.splitters, skeleton.nodes):
        lengths = np.ascontiguousarray(np.frombuffer(path, np.uint8).reshape(-1, TURN_BYTES)[:, HASH_BYTES:]).view(">u4").ravel()
        for k, length in zip(way[1:].tolist(), lengths.tolist()):
            size[k] = length
    for k in range(n - 1, -1, -1):
        if not members[k]:
            continue
        leaves[k] += children[k] == 0
        saved[k] += (members[k] - 1) * size[k]
        up = skeleton.parent[k]
        if up >= 0:
            members[up] += members[k]
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
            least[up] = least[k] if least[up] is None else min(least[up], least[k])
    rows = [
        (k, least[k], skeleton.depth[k], least[skeleton.parent[k]] if k else None, members[k], children[k], leaves[k], saved[k])
        for k in range(n)
        if members[k]
    ]
    kinds = "skeleton long, " + ", ".join(f"{c} long" for c in COLUMNS[:-1])
    return spark.createDataFrame(rows, kinds)


def prefix_trie(table: DataFrame) -> DataFrame:
    """The trie of ``conv_id, path`` (see ``paths``), a row for each node: each distinct beginning of a path.

    Members of a node are the conversations whose paths begin with it.  ``conv_id``: smallest member; ``depth``: turns;
    ``parent_conv_id``: that of the node without the last turn, null at the root; ``n_convs``: members; ``n_children``;
    ``n_leaves``: childless nodes in the subtree, itself included; ``saved_tokens``: sum over the subtree of the bytes of
    a node's last text times its members but one; ``ends_sha256``: of the ids of the conversations that end here, by
    number and joined with commas.

    Paths are sorted and cut at splitters into shards.  The nodes on the splitters' paths are the skeleton: only they
    have members in several shards.  It is broadcast, at most ``SKELETON_TURNS`` turns of 20 bytes; each shard finishes
    all other nodes on its own and sends a part for each node of the skeleton that it meets, and the parts are added up,
    then carried up the skeleton.  Equal paths are cut by id, so conversations with very many copies are spread.

    An id may come once.  Conversations without turns are members of the root; an empty table has no root and gives no
    row.  A path is one value: 20 bytes a turn.
    """
    spark = table.sparkSession
    tables = Tables(spark, "trie")
    whole = Skeleton.of(_splitters(table))
    skeleton = spark.sparkContext.broadcast(whole)
    tasks = min(len(whole.splitters) + 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(whole.splitters) // 256))
    parts = tables.write(
        table.select("path", "conv_id")
        .mapInArrow(_placed(skeleton), "shard int, path binary, conv_id long")
        .repartition(tasks, "shard")
        .sortWithinPartitions("shard", "path", "conv_id")
        .mapInArrow(_finished(skeleton), _FINISHED)
    )
    open_nodes = _skeleton_rows(spark, whole, parts)
    ends = (
        parts.where("ends IS NOT NULL")
        .select("skeleton", "conv_id", "ends")
        .repartition("skeleton")
        .sortWithinPartitions("skeleton", "conv_id")
        .mapInArrow(_digests, "skeleton long, digest string")
    )
    bones = open_nodes.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(_NO_ENDS)))
    above = F.broadcast(open_nodes.select("skeleton", F.col("conv_id").alias("above")))
    closed = parts.where("depth IS NOT NULL").join(above, "skeleton", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above")
    )
    return closed.select(*COLUMNS).unionByName(bones.select(*COLUMNS))


def conversation_trie(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``prefix_trie`` of ``conversations (conv_id, turn, role, text)``, each rebuilt from two (see ``rebuilt``).

    Null roles and texts are empty, rows without conv_id are left out, extra columns change nothing.  Turns are ordered by
    number, null first, and turns of one number by their digests; repeated rows are turns of their own.
    """
    whole = paths(rebuilt(turns(conversations), group, most))
    return prefix_trie(Tables(conversations.sparkSession, "paths").write(whole))
