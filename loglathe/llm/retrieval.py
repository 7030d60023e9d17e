"""Exact top-k by inner product: vectors in buckets of like length, pruned bucket by bucket, products verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglathe.llm.tables import Tables

#: Vectors of a bucket and queries of a block.
BUCKET_ROWS = 4096
BLOCK_ROWS = 512
#: Bytes of the buckets that a task holds, while blocks of queries go by.
HELD_BYTES = 64 << 20
#: Rows of a block product that cost as much as one row that is picked out for a single query.
PICKED = 32
_NONE = np.iinfo(np.int64).min


def integer_vectors(table: DataFrame, id_column: str, vector: str, scale: int = 256) -> DataFrame:
    """``id, v``: components as ``floor(scale * x)``.  Rows without id, and vectors null, empty or with a null or
    non-finite component, or one beyond 64 bits, are left out."""
    x = F.col(vector).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * scale))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < 2.0**62))
    return (
        table.where(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
        .select(F.col(id_column).cast("long").alias("id"), whole.cast("array<long>").alias("v"))
    )


def _packed(rows: int):
    """Rows, sorted by dimension and falling length, as blocks of at most ``rows`` vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            ids, matrix = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([matrix.shape[1]], pa.int32()),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([float(_length(matrix).max())], pa.float64()),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([matrix.tobytes()], pa.binary()),
                ],
                ["dim", "n", "longest", "ids", "matrix"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("id").to_numpy(), batch.column("v")
            offsets = v.offsets.to_numpy()
            values, offsets = v.flatten().to_numpy(), offsets - offsets[0]
            dims = np.diff(offsets)
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(ids)]
            for i, j in zip(cuts, cuts[1:]):
                part = values[offsets[i] : offsets[j]].reshape(j - i, dims[i])
                if held and held[0][1].shape[1] != dims[i]:
                    yield close()
                at = 0
                while at < j - i:
                    take = min(j - i - at, rows - sum(len(x) for x, _ in held))
                    held.append((ids[i + at : i + at + take], part[at : at + take]))
                    at += take
                    if sum(len(x) for x, _ in held) == rows:
                        yield close()
        if held:
            yield close()

    return run


def _kind(reach: float) -> type:
    """Numbers in which products are exact: ``reach``, the product of two lengths, bounds every partial sum."""
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


def _length(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(float) ** 2).sum(axis=1))


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of every query with every vector: whole numbers, as floats where those hold them exactly."""
    kind = _kind((1 + 1e-9) * _length(queries).max() * _length(vectors).max())
    return queries.astype(kind) @ vectors.T.astype(kind)


def _unpack(dim: int, n: int, ids: bytes, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int64).reshape(n, dim)


class Bucket:
    """Vectors of like length, with their directions sorted along each coordinate that a query asks for."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        lengths = _length(matrix)
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.matrix, self.falling = ids[order], matrix[order], lengths[order]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.by_id = np.argsort(self.ids, kind="stable")
        self.copies: dict[type, np.ndarray] = {}

    def along(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self.sorted:
            values = self.matrix[:, coordinate] / np.maximum(self.falling, 1e-300)
            order = np.argsort(values, kind="stable")
            self.sorted[coordinate] = order, values[order]
        return self.sorted[coordinate]

    def as_kind(self, kind: type) -> np.ndarray:
        if kind not in self.copies:
            self.copies[kind] = self.matrix.astype(kind)
        return self.copies[kind]

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ``ids`` are in the bucket, and the rows of those."""
        at = np.minimum(np.searchsorted(self.ids, ids, sorter=self.by_id), len(self.ids) - 1)
        rows = self.by_id[at]
        held = np.flatnonzero(self.ids[rows] == ids)
        return held, rows[held]

    def pruned(
        self, queries: np.ndarray, lengths: np.ndarray, levels: np.ndarray
    ) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Rows whose product with a query may reach its level: how many of the longest, for each query, and for some
        queries the rows themselves, which are fewer.

        Length pruning keeps the vectors with ``|q| |v| >= level``.  From the local threshold ``level / (|q| longest)``
        on the cosine follows a range for the direction's value at the query's strongest coordinate; coordinate pruning
        keeps the vectors in it.  It is used where it keeps so few that they are cheaper to pick out.
        """
        longest = self.falling[0]
        least = levels.astype(float)
        least = least - (1e-9 * (np.abs(least) + lengths * longest) + 0.5)
        bound = (least > 0) & (lengths > 0)
        count = np.full(len(queries), len(self.ids))
        need = least[bound] / lengths[bound]
        cosine = need / longest if longest > 0 else np.full(len(need), 2.0)
        some = np.searchsorted(-self.falling, -need, "right")
        some[cosine > 1] = 0
        count[bound] = some
        picked = {}
        focus = np.argmax(np.abs(queries), axis=1)
        asked = np.flatnonzero(bound)[some > 0]
        cosine = cosine[some > 0]
        share = queries[asked, focus[asked]] / lengths[asked]
        reach = np.sqrt(np.maximum(0.0, (1 - share * share) * (1 - cosine * cosine)))
        # the direction along the coordinate itself may be near enough
        low = np.where(share < -cosine, -1.0, share * cosine - reach) - 1e-9
        high = np.where(share > cosine, 1.0, share * cosine + reach) + 1e-9
        for coordinate in np.unique(focus[asked]):
            here = np.flatnonzero(focus[asked] == coordinate)
            order, values = self.along(int(coordinate))
            a, b = np.searchsorted(values, low[here]), np.searchsorted(values, high[here], "right")
            for j in np.flatnonzero((b - a) * PICKED < count[asked[here]]):
                picked[int(asked[here[j]])] = order[a[j] : b[j]]
        return count, picked


class Best:
    """The best hits of a block of queries so far, and the levels that further ones have to reach."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, levels: np.ndarray, k: int) -> None:
        self.own, self.queries, self.levels, self.k = own, queries, levels.copy(), k
        self.lengths = _length(queries)
        self.rows = np.zeros(0, np.int64)
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, bucket: Bucket) -> None:
        count, picked = bucket.pruned(self.queries, self.lengths, self.levels)
        rows, ids, scores = [self.rows], [self.ids], [self.scores]
        for i, near in picked.items():
            near = near[bucket.ids[near] != self.own[i]]
            if len(near):
                found = _products(self.queries[i : i + 1], bucket.matrix[near])[0]
                near, found = self._few(bucket.ids[near], found, self.levels[i])
                rows.append(np.full(len(near), i))
                ids.append(near)
                scores.append(found.astype(np.int64))
            count[i] = 0
        dense = np.flatnonzero(count)
        if len(dense):
            most = count[dense].max()
            kind = _kind((1 + 1e-9) * self.lengths[dense].max() * bucket.falling[0])
            products = self.queries[dense].astype(kind) @ bucket.as_kind(kind)[:most].T
            levels = self.levels[dense].astype(kind)
            reached = products >= levels[:, None]
            held, place = bucket.places(self.own[dense])
            reached[held[place < most], place[place < most]] = False
            hits = reached.sum(axis=1)
            light = hits <= 8 * self.k
            for j in np.flatnonzero(~light):
                near = np.flatnonzero(reached[j])
                near, found = self._few(bucket.ids[near], products[j, near], self.levels[dense[j]])
                rows.append(np.full(len(near), dense[j]))
                ids.append(near)
                scores.append(found.astype(np.int64))
            reached[~light] = False
            j, near = np.nonzero(reached)
            rows.append(dense[j])
            ids.append(bucket.ids[near])
            scores.append(products[j, near].astype(np.int64))
        self._keep(np.concatenate(rows), np.concatenate(ids), np.concatenate(scores))

    def _few(self, ids: np.ndarray, scores: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of one query's hits, by score and then by id."""
        keep = scores >= level
        ids, scores = ids[keep], scores[keep]
        if len(ids) > self.k:
            last = np.partition(scores, -self.k)[-self.k]
            above, equal = np.flatnonzero(scores > last), np.flatnonzero(scores == last)
            ties = self.k - len(above)
            if len(equal) > ties:
                equal = equal[np.argpartition(ids[equal], ties - 1)[:ties]]
            keep = np.concatenate([above, equal])
            ids, scores = ids[keep], scores[keep]
        return ids, scores

    def _keep(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(rows) == len(self.rows):
            return
        # complemented and not negated, since the least number has no opposite
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, rows, "left")
        nth = np.arange(len(rows)) - first
        kept = nth < self.k
        last = nth == self.k - 1
        self.levels[rows[last]] = np.maximum(self.levels[rows[last]], scores[last])
        self.rows, self.ids, self.scores = rows[kept], ids[kept], scores[kept]


def _first_scores(k: int, tops: list[tuple[int, bytes, bytes]]):
    """The k-th best score of each query among a few long vectors of its dimension: what a hit has to reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = []
            for dim, n, ids, matrix in zip(batch["dim"], batch["n"], batch["ids"], batch["matrix"]):
                own, queries = _unpack(dim, n, ids, matrix)
                level = np.full(n, _NONE)
                for top_dim, top_ids, top_matrix in tops:
                    if top_dim == dim:
                        held = np.frombuffer(top_ids, np.int64)
                        scores = _products(queries, np.frombuffer(top_matrix, np.int64).reshape(-1, dim))
                        scores[own[:, None] == held[None, :]] = -np.inf if scores.dtype.kind == "f" else _NONE
                        if len(held) > k:
                            level = np.maximum(level, np.partition(scores, -k, axis=1)[:, -k].astype(np.int64))
                least.append(level.tobytes())
            floors = [float(np.frombuffer(x, np.int64).min()) for x in least]
            yield batch.assign(least=least, floor=floors)

    return run


def _searched(k: int):
    """Rows of a task by cell: its buckets, the longest first, then blocks of queries that meet all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, buckets = None, {}
        for batch in batches:
            for r in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                if cell != r["cell"]:
                    cell, buckets = r["cell"], {}
                ids, matrix = _unpack(r["dim"], r["n"], r["ids"], r["matrix"])
                if r["least"] is None:
                    buckets.setdefault(r["dim"], []).append(Bucket(ids, matrix))
                    continue
                best = Best(ids, matrix, np.frombuffer(r["least"], np.int64), k)
                for bucket in buckets.get(r["dim"], []):
                    best.meet(bucket)
                columns = (best.own[best.rows], best.ids, best.scores)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """For each row of ``queries (id, v)`` the ``k`` rows of ``vectors (id, v)`` with the highest integer inner product.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``; ties go to the smaller id, a query's own id is no hit, fewer
    vectors give fewer rows.  Vectors of another dimension have no product with a query.  A repeated id counts once,
    with the smallest of its vectors.

    Vectors are sorted by length and cut into buckets of ``BUCKET_ROWS``, queries into blocks of ``BLOCK_ROWS``.  Each
    query first gets the k-th best score in the bucket of the longest vectors (one for each dimension).  A task holds a
    group of buckets of about ``HELD_BYTES`` while blocks go by.  A block comes to a group only if lengths allow such a
    score; in each bucket, the longest first, each query is pruned by length or coordinate (see ``Bucket``) with the k-th
    best score it has by then, and the remaining products are computed exactly, for all queries of the block at once.  No
    bound is dropped, so the result is exact.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "retrieval")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    def blocks(rows: DataFrame, size: int) -> DataFrame:
        one = rows.groupBy("id").agg(F.min("v").alias("v"))
        sized = one.withColumns({"dim": F.size("v"), "length": length})
        return (
            sized.repartitionByRange("dim", F.desc("length"), "id")
            .sortWithinPartitions("dim", F.desc("length"), "id")
            .select("id", "v")
            .mapInArrow(_packed(size), "dim int, n int, longest double, ids binary, matrix binary")
        )

    buckets = tables.write(blocks(vectors, BUCKET_ROWS).withColumn("bucket", F.monotonically_increasing_id()))
    # without the vectors: a row for thousands of them
    numbered = buckets.select("bucket", "dim", "longest").withColumns(
        {
            "number": F.row_number().over(Window.orderBy("dim", F.desc("longest"), "bucket")) - 1,
            "nth": F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "bucket")),
        }
    )
    numbered = tables.write(numbered)
    # one bucket for each dimension: the longest vectors
    first = numbered.where("nth = 1").select("bucket").limit(64)
    tops = buckets.join(F.broadcast(first), "bucket", "left_semi").select("dim", "ids", "matrix").collect()
    kind = "dim int, n int, longest double, ids binary, matrix binary, least binary, floor double"
    asked = tables.write(
        blocks(queries, BLOCK_ROWS)
        .mapInPandas(_first_scores(k, [(t["dim"], bytes(t["ids"]), bytes(t["matrix"])) for t in tops]), kind)
        .withColumn("block", F.monotonically_increasing_id())
    )
    # a cell is a group of buckets and a share of the blocks: shares, where there are fewer buckets than tasks
    held = buckets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("n").cast("long") * F.col("dim") * 8), F.lit(0)).alias("b"))
    held = held.first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(held["n"], max(tasks, -(-held["b"] // HELD_BYTES))))
    shares = max(1, min(asked.count(), -(-tasks // groups)))
    grouped = numbered.withColumn("part", (F.col("number") % groups).cast("int"))
    parts = grouped.groupBy("dim", "part").agg(F.max("longest").alias("part_longest"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    row = ("cell", "dim", "n", "longest", "ids", "matrix", "least")
    cell = (F.col("part") * shares + F.col("share")).cast("int").alias("cell")
    kept = (
        buckets.join(F.broadcast(grouped.select("bucket", "part")), "bucket")
        .withColumn("least", F.lit(None).cast("binary"))
        .select("*", every)
    )
    named = (
        asked.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
        .join(F.broadcast(parts), "dim")
        .where("longest * part_longest * (1 + 1e-9) + 1 >= floor")
    )
    met = kept.select(cell, *row[1:]).unionByName(named.select(cell, *row[1:]))
    hits = (
        met.repartitionById(groups * shares, "cell")
        .sortWithinPartitions("cell", F.col("least").isNotNull(), "dim", F.desc("longest"))
        .mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
