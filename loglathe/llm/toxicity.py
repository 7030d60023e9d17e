"""Toxicity: a factorization machine over hashed terms, learnt from labelled documents."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.llm.tables import Tables
from loglathe.llm.words import _FOLDED, _Powers, mix, slices, text_bytes

#: Labelled documents to learn from, at most: those with the smallest hash of their id.
MAX_TOXIC, MAX_OTHER = 8_000, 12_000
#: Terms are hashed to ``2 ** BITS`` buckets; the model keeps up to ``TERMS`` of them, with ``FACTORS`` factors each.
BITS, TERMS, FACTORS = 18, 2048, 4
#: A term is kept if its share among toxic documents is that many standard deviations from its share overall.
SURE = 3.0
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.1, 2e-4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_HEADS = (4, 5)


def term_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of all terms: runs of letters and digits (A-Z lower-cased) and the first bytes of longer ones."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _LETTER[data]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _Powers.of(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_FOLDED[data] * up, out=total[1:])
    row = np.searchsorted(offsets, starts, "right") - 1
    rows, terms = [row], [mix((total[ends] - total[starts]) * down[starts])]
    for k, width in enumerate(_HEADS, 1):
        longer = ends - starts > width
        s = starts[longer]
        rows.append(row[longer])
        terms.append(mix((total[s + width] - total[s]) * down[s] + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(terms) >> np.uint64(64 - BITS)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in slices(offsets):
            part = offsets[i : j + 1] - offsets[i]
            rows, terms = term_pairs(data[offsets[i] : offsets[j]], part)
            code = np.unique(rows << BITS | terms)
            bounds = np.searchsorted(code, np.arange(j - i + 1) << BITS)
            held = [(code[a:b] & ((1 << BITS) - 1)).astype(np.uint32).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(i, j - i), pa.array(held, pa.binary())], ["label", "terms"]
            )


class Machine:
    """``bias + sum of weights + sum over pairs of products of factors``, over the distinct kept terms of a text."""

    def __init__(self, buckets, bias, weights, factors) -> None:
        self.buckets, self.bias, self.weights, self.factors = buckets, bias, weights, factors
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))

    def score(self, rows: np.ndarray, terms: np.ndarray, count: int) -> np.ndarray:
        place = self.place[terms]
        known = place >= 0
        code = np.unique(rows[known] * len(self.buckets) + place[known]) if len(self.buckets) else np.zeros(0, np.int64)
        row, term = (code // len(self.buckets), code % len(self.buckets)) if len(code) else (code, code)
        value = self.bias + np.bincount(row, self.weights[term], count)
        for f in range(self.factors.shape[1]):
            own = self.factors[term, f]
            value += (np.bincount(row, own, count) ** 2 - np.bincount(row, own * own, count)) / 2
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, buckets=self.buckets, bias=self.bias, weights=self.weights, factors=self.factors)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Machine:
        held = np.load(io.BytesIO(raw))
        return cls(held["buckets"], float(held["bias"]), held["weights"], held["factors"])


def fit(labels: np.ndarray, texts: list[np.ndarray]) -> Machine:
    """Learns by AdaGrad on the logistic loss; equal term sets count once."""
    _, once = np.unique(np.array([t.tobytes() for t in texts], object), return_index=True)
    once.sort()
    labels, texts = labels[once].astype(float), [texts[i] for i in once]
    n, share = len(labels), labels.mean()
    every = np.bincount(np.concatenate(texts), minlength=1 << BITS).astype(float)
    toxic = np.bincount(np.concatenate([t for t, y in zip(texts, labels) if y] or [texts[0][:0]]), minlength=1 << BITS)
    lean = (toxic - every * share) / np.sqrt(np.maximum(every * share * (1 - share) * (1 - every / n), 1.0))
    buckets = np.argsort(-np.abs(lean), kind="stable")[:TERMS]
    buckets = np.sort(buckets[np.abs(lean[buckets]) >= SURE])
    place = np.full(1 << BITS, -1, np.int64)
    place[buckets] = np.arange(len(buckets))
    kept = [p[p >= 0] for p in (place[t] for t in texts)]
    rng = np.random.default_rng(5)
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (10.0 if share else -10.0)
    weights, factors = np.zeros(len(buckets)), rng.normal(0, 0.02, (len(buckets), FACTORS))
    if not len(buckets) or not 0 < share < 1:
        return Machine(buckets, bias, weights, factors * 0)
    seen_b, seen_w, seen_f = 1e-8, np.full(len(weights), 1e-8), np.full(factors.shape, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            x = np.zeros((len(rows), len(buckets)))
            for i, r in enumerate(rows):
                x[i, kept[r]] = 1
            sums = x @ factors
            value = bias + x @ weights + ((sums**2).sum(axis=1) - (x @ (factors**2)).sum(axis=1)) / 2
            error = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - labels[rows]) / len(rows)
            slope = x.T @ error
            slope_f = x.T @ (error[:, None] * sums) - factors * slope[:, None] + DECAY * factors
            slope += DECAY * weights
            seen_b += error.sum() ** 2
            seen_w += slope**2
            seen_f += slope_f**2
            bias -= RATE * error.sum() / np.sqrt(seen_b)
            weights -= RATE * slope / np.sqrt(seen_w)
            factors -= RATE * slope_f / np.sqrt(seen_f)
    return Machine(buckets, bias, weights, factors)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, texts = [], []
    for batch in batches:
        labels += batch.column("label").to_pylist()
        texts += [np.frombuffer(t, np.uint32) for t in batch.column("terms").to_pylist()]
    if labels:
        # rows come in any order: the result must not depend on it
        order = sorted(range(len(labels)), key=lambda i: (texts[i].tobytes(), labels[i]))
        model = fit(np.array([labels[i] for i in order]), [texts[i] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])


def learn(docs: DataFrame, labels: DataFrame, allowed: Column) -> Machine | None:
    """The machine learnt from documents with ``labels (doc_id, toxic)`` whose ``doc_id`` is ``allowed``.

    A bounded sample is used, ``MAX_TOXIC`` toxic and ``MAX_OTHER`` other documents; the bias is then set right for
    the odds among all allowed labels, which are counted.  The sample's ids are broadcast, so texts aren't shuffled;
    terms are made where the texts are, and one task fits the model.  Null labels don't count, a
    document with several labels is toxic if one says so.  ``None`` without any labelled document.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(allowed)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = one.where("label = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(
        one.where("label <> 1").orderBy(*order).limit(MAX_OTHER)
    )
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = (
        given.join(F.broadcast(chosen), "doc_id")  # MAX_TOXIC + MAX_OTHER rows at most
        .select("label", "text")
        .mapInArrow(_features, "label int, terms binary")
    )
    held = Tables(docs.sparkSession, "toxicity").write(terms)
    found = held.repartition(1).mapInArrow(_fitted, "model binary").collect()
    if not found:
        return None
    model = Machine.load(bytes(found[0]["model"]))
    toxic, other = one.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first()
    if toxic and other:
        model.bias += float(np.log(toxic / min(toxic, MAX_TOXIC)) - np.log(other / min(other, MAX_OTHER)))
    return model


def _scored(raw: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Machine.load(raw) if raw else None
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            if model:
                data, offsets = text_bytes(batch.column("text"))
                for i, j in slices(offsets):
                    part = offsets[i : j + 1] - offsets[i]
                    scores[i:j] = model.score(*term_pairs(data[offsets[i] : offsets[j]], part), j - i)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Machine | None) -> DataFrame:
    """``doc_id, score`` for every row of ``docs (doc_id, text, ...)``: 0 to 1, higher where toxic is likelier.

    Terms of the whole text count once each.  An empty or null text has the score of no terms, every text 0 without a
    model.  One pass without a shuffle; repeated rows and null ids stay, other columns are ignored.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_scored(model.dump() if model else None), "doc_id long, score double")
