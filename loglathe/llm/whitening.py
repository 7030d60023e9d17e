"""Whitened embeddings: covariances by polarisation, from exact sums of squares of dimensions and of sums of two."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.tables import Tables

#: Rows that are squared at a time: so many squares of ``HALF``-bit numbers still fit a 64-bit sum.
ROWS = 2048
HALF = 26
#: Sums of any size travel as parts of so many bits.
PART_BITS = 60
#: Share of the trace below which a direction counts as without spread.
FLAT = 1e-12

_SUMS = "dim int, i int, j int, part int, value decimal(38,0)"


def whole_vectors(table: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """``id, x``: entries as ``floor(scale * c)``; vectors null, empty, or with an entry null, not finite or beyond 62 bits
    are left out."""
    given = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("c"))
    fine = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < 2.0**62))
    return given.where(F.col("c").isNotNull() & (F.size("c") > 0) & fine).select(
        "id", F.transform("c", lambda c: F.floor(c * scale).cast("long")).alias("x")
    )


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one dimension as matrices of at most ``ROWS`` rows, with the places of the rows."""
    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        places = np.flatnonzero(sizes == dim)
        for at in range(0, len(places), ROWS):
            some = places[at : at + ROWS]
            yield some, values[offsets[some][:, None] + np.arange(dim)]


def _parts(total: int) -> list[int]:
    """A number as parts of ``PART_BITS`` bits; only the last one carries the sign."""
    out = []
    while not -1 << PART_BITS < total < 1 << PART_BITS:
        out.append(total & ((1 << PART_BITS) - 1))
        total >>= PART_BITS
    return [*out, total]


def _rows_of_sums(held: dict[tuple[int, int, int], int]) -> Iterator[pa.RecordBatch]:
    rows = [(*key, k, part) for key, total in held.items() for k, part in enumerate(_parts(int(total)))]
    if rows:
        dim, i, j, part, value = zip(*rows)
        exact = pa.array(value, pa.int64()).cast(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(dim, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(part, pa.int32()), exact],
            ["dim", "i", "j", "part", "value"],
        )


def _added(rows: DataFrame) -> dict[tuple[int, int, int], int]:
    """Sums over all tasks, by key; their number follows from the dimensions alone."""
    total: dict[tuple[int, int, int], int] = {}
    for r in rows.groupBy("dim", "i", "j", "part").agg(F.sum("value").alias("value")).collect():
        key = (r["dim"], r["i"], r["j"])
        total[key] = total.get(key, 0) + (int(r["value"]) << (PART_BITS * r["part"]))
    return total


def _first_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension of the space: rows (key -1, 0) and the sum of each entry (key i, 0)."""
    held: dict[tuple[int, int, int], int] = {}
    for batch in batches:
        for _, x in _matrices(batch.column("x")):
            dim = x.shape[1]
            # halves add up without overflow, whatever the entries
            low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
            for i in range(dim):
                key = (dim, i, 0)
                held[key] = held.get(key, 0) + (int(high[i]) << 32) + int(low[i])
            held[dim, -1, 0] = held.get((dim, -1, 0), 0) + len(x)
    yield from _rows_of_sums(held)


def _centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """``n * x - S`` exactly: as 64-bit numbers where these and sums of two fit, else as Python's."""
    if 4 * n * (largest + 1) < 1 << (2 * HALF):
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(values: np.ndarray) -> np.ndarray:
    """Exact sums of squares of the columns."""
    if values.dtype == object:
        return (values * values).sum(axis=0)
    high, low = values >> HALF, values & ((1 << HALF) - 1)
    parts = [(a * b).sum(axis=0).astype(object) for a, b in ((high, high), (high, low), (low, low))]
    return (parts[0] << (2 * HALF)) + (parts[1] << (HALF + 1)) + parts[2]


def _square_sums(spaces: dict[int, tuple[int, list[int]]]):
    """Sums of squares of each centred entry (key i, i) and of each sum of two centred entries (key i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, x in _matrices(batch.column("x")):
                dim = x.shape[1]
                n, sums = spaces[dim]
                d = _centred(x, n, sums, int(np.abs(x).max()))
                own = [_squares(d)] + [_squares(d[:, i : i + 1] + d[:, i + 1 :]) for i in range(dim - 1)]
                held[dim] = [a + b for a, b in zip(held[dim], own)] if dim in held else own
        totals = {}
        for dim, (single, *pairs) in held.items():
            totals |= {(dim, i, i): single[i] for i in range(dim)}
            totals |= {(dim, i, i + 1 + k): s for i, row in enumerate(pairs) for k, s in enumerate(row)}
        yield from _rows_of_sums(totals)

    return run


class Axes:
    """Mean, components and their eigenvalues of one space."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int], count: int) -> None:
        self.n, self.sums = n, sums
        dim = len(sums)
        cubed = n**3
        covariance = np.zeros((dim, dim))
        for i, j in combinations_with_replacement(range(dim), 2):
            # var(a + b) = var(a) + var(b) + 2 cov(a, b); quotients of whole numbers are rounded once
            shared = squares[i, i] if i == j else squares[i, j] - squares[i, i] - squares[j, j]
            covariance[i, j] = covariance[j, i] = shared / (cubed if i == j else 2 * cubed)
        values, vectors = np.linalg.eigh(covariance)
        self.values = values[::-1][:count]
        self.vectors = vectors[:, ::-1][:, :count]
        trace = sum(squares[i, i] for i in range(dim)) / cubed
        self.explained = [float(v / trace) if trace > 0 else None for v in self.values]
        self.wide = [trace > 0 and v > FLAT * trace for v in self.values]
        scale = [1 / np.sqrt(v) if w else np.nan for v, w in zip(self.values, self.wide)]
        self.scaled = self.vectors * np.array(scale)
        self.mean = np.array([s / n for s in sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        # the whole part of the mean goes first, exactly
        near = np.rint(self.mean)
        return ((x - near) - (self.mean - near)) @ self.scaled


def _products(axes: dict[int, Axes]):
    """Sums of products of whitened values, pair of components by pair; (i, -1) are the plain sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            for _, x in _matrices(batch.column("x")):
                dim = x.shape[1]
                w = axes[dim].whitened(x)
                both, plain = w.T @ w, w.sum(axis=0)
                for i in range(w.shape[1]):
                    for j in range(i, w.shape[1]):
                        held[dim, i, j] = held.get((dim, i, j), 0.0) + float(both[i, j])
                    held[dim, i, -1] = held.get((dim, i, -1), 0.0) + float(plain[i])
        if held:
            dim, i, j = zip(*held)
            columns = [pa.array(c, pa.int32()) for c in (dim, i, j)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(held.values(), pa.float64())], ["dim", "i", "j", "value"])

    return run


def _identity_errors(fit: DataFrame, axes: dict[int, Axes]) -> dict[int, float | None]:
    """Largest deviation of the whitened values' covariance from the identity, for each space."""
    sums = fit.mapInArrow(_products(axes), "dim int, i int, j int, value double").groupBy("dim", "i", "j")
    total = {(r["dim"], r["i"], r["j"]): r["value"] for r in sums.agg(F.sum("value").alias("value")).collect()}
    errors: dict[int, float | None] = {}
    for dim, a in axes.items():
        wide = [i for i, w in enumerate(a.wide) if w]
        entries = [
            abs(total[dim, i, j] / a.n - total[dim, i, -1] / a.n * (total[dim, j, -1] / a.n) - (i == j))
            for i, j in combinations_with_replacement(wide, 2)
        ]
        errors[dim] = max(entries, default=None)
    return errors


def _results(axes: dict[int, Axes], errors: dict[int, float | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for places, x in _matrices(batch.column("x")):
                a, dim = axes[x.shape[1]], x.shape[1]
                d = _centred(x, a.n, a.sums, int(np.abs(x).max()))
                if d.dtype != object and dim * int(np.abs(d).max()) ** 2 >= 1 << 63:
                    d = d.astype(object)
                deviation = (d * d).sum(axis=1)
                count = len(a.values)
                w = a.whitened(x).ravel()
                if d.dtype == object:
                    kept = [v if v < 10**38 else None for v in np.repeat(deviation, count)]
                    exact = pa.array(kept, pa.decimal128(38, 0))
                else:
                    exact = pa.array(np.repeat(deviation, count)).cast(pa.decimal128(38, 0))
                many = len(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(places, count))),
                        pa.array(np.tile(np.arange(1, count + 1), many), pa.int32()),
                        pa.array(np.full(many * count, a.n), pa.int64()),
                        exact,
                        pa.array(w, pa.float64(), from_pandas=True),
                        pa.array(a.explained * many, pa.float64()),
                        pa.array([errors[dim]] * (many * count), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(table: DataFrame, id_column: str, vector: str, *, components: int = 4, scale: int = 256) -> DataFrame:
    """Every usable vector on the first principal components of all distinct ones, scaled to unit variance.

    Entries become whole numbers ``x = floor(scale * c)``.  The fit list is each distinct x once: ``n`` vectors with sums
    ``S``.  Returns ``id, component`` (from 1, by falling eigenvalue), ``n, deviation`` (sum of ``(n * x - S)**2``,
    decimal), ``whitened, explained`` (share of the trace) and ``identity_error`` (largest absolute entry of the
    covariance of the whitened fit list minus the identity).

    The variance of every entry and of every sum of two entries is added up exactly, centred before squaring; their
    differences give all covariances.  Tasks send sums for pairs of dimensions, so the driver holds
    ``dim * (dim + 1) / 2`` numbers whatever the table's size.

    Vectors null, empty or with an entry null, not finite or beyond 62 bits take no part.  Rows with a null id and
    repeated rows stay; extra columns change nothing.  Vectors of different dimensions are separate spaces, each with its
    own fit list.  Fewer dimensions than components give fewer rows.  Where a component has no spread, ``whitened`` is
    null and no part of the error, which is null without any such component; where nothing has, ``explained`` is null.
    A deviation of more than 38 digits is null.  An empty table gives an empty one.
    """
    tables = Tables(table.sparkSession, "whitening")
    vectors = whole_vectors(table, id_column, vector, scale)
    # equal vectors meet after one per task is left of each
    fit = tables.write(vectors.select("x").distinct())
    first = _added(fit.mapInArrow(_first_sums, _SUMS))
    dims = [dim for dim, i, _ in first if i == -1]
    spaces = {dim: (first[dim, -1, 0], [first[dim, i, 0] for i in range(dim)]) for dim in dims}
    second = _added(fit.mapInArrow(_square_sums(spaces), _SUMS))
    axes = {
        dim: Axes(n, sums, {(i, j): s for (d, i, j), s in second.items() if d == dim}, components)
        for dim, (n, sums) in spaces.items()
    }
    errors = _identity_errors(fit, axes)
    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(
        _results(axes, errors),
        f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double",
    )
