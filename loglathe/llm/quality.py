"""Quality rules: countable faults of a text, and a hashed n-gram likelihood ratio of trusted text against the corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.tables import Tables

#: Buckets of one-word and of two-word terms each.
BUCKETS = 1 << 16
#: Standard deviations below the trusted documents' mean ratio at which a text is rejected.
DEVIATIONS = 5.0

#: A ratio is kept as one of ``2 * MIDDLE`` levels, ``PER_UNIT`` to a unit.
MIDDLE, PER_UNIT = 64, 8
#: Bits of a window's place in the number that it is sorted by; the others are of its hash.
PLACE_BITS = 14

#: Bytes of an id in a broadcast, and how many such bytes are broadcast.
ID_BYTES, BROADCAST_BYTES = 16, 64 << 20

_SYMBOLS = "#*$%&|<>"


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` refers to it inside a lambda.

    It also keeps loops over a text's words out of the generated code of the whole stage, which would grow beyond the
    size up to which the JVM compiles a method.
    """
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return bound(parts, lambda p: F.array_remove(p, ""))


def _repeated(all_words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more."""
    windows = bound(
        F.transform(all_words, lambda w: F.xxhash64(w)),
        lambda u: F.when(
            F.size(u) >= 3,
            F.transform(F.slice(u, F.lit(3), F.size(u)), lambda z, i: F.xxhash64(F.get(u, i), F.get(u, i + 1), z)),
        ).otherwise(F.array().cast("array<bigint>")),
    )

    def covered(hashes: Column) -> Column:
        # place and hash in one number sort fastest; a text with more windows than places has pairs sorted
        packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long"))))
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal_neighbours(ordered: Column, same) -> Column:
            return bound(
                ordered,
                lambda s: F.flatten(
                    F.array_compact(
                        F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.when(same(x, y), F.array(x, y)))
                    )
                ),
            )

        places = F.when(
            F.size(hashes) < 1 << PLACE_BITS,
            F.transform(
                equal_neighbours(packed, lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0),
                lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int"),
            ),
        ).otherwise(F.transform(equal_neighbours(pairs, lambda x, y: x["h"] == y["h"]), lambda x: x["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(x, x + 1, x + 2)))))

    return bound(
        windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    ).cast("long")


def base_columns(text: Column, all_words: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(all_words).cast("long"),
        "word_chars": bound(all_words, lambda w: F.length(F.array_join(w, ""))).cast("long"),
        "n_symbols": bound(
            text,
            lambda t: F.when(
                t.rlike(f"[{_SYMBOLS}]"), F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))
            ).otherwise(F.lit(0)),
        ).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated(all_words),
    }


def _one(code: Column) -> Column:
    """Bucket of a one-word term; codes are not negative, so this is the remainder."""
    return code.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


def _two(code: Column, following: Column) -> Column:
    return _one(code * 31 + following) + BUCKETS


def _levels(spark: SparkSession, table: bytes) -> Column:
    """The table as a value that plans name and don't spell out.

    As a constant it would stand in each text of each plan, 2.4 MB at a time, of which the driver keeps many.
    """
    return spark.createDataFrame([(list(table),)], "levels array<tinyint>").scalar()


def _mean_ratio(all_words: Column, levels: Column) -> Column:
    """Mean of the table's values over a text's one-word and two-word terms, 0 for a text without words."""
    none = F.lit(0).cast("long")

    def mean(u: Column, table: Column) -> Column:
        level = lambda term: F.get(table, term).cast("long")
        own = F.zip_with(
            u, F.slice(u, F.lit(2), F.size(u)), lambda x, y: level(_one(x)) + F.coalesce(level(_two(x, y)), none)
        )
        n = 2 * F.size(u) - 1
        return (F.aggregate(own, none, lambda s, x: s + x) - MIDDLE * n) / F.lit(float(PER_UNIT)) / n

    codes = F.transform(all_words, lambda w: F.crc32(w))
    ratio = bound(levels, lambda table: bound(codes, lambda u: mean(u, table)))
    return F.when(F.size(all_words) == 0, F.lit(0.0)).otherwise(ratio)


def _counts(texts: DataFrame) -> dict[int, int]:
    """One-word and two-word terms of ``text`` in each bucket; at most ``2 * BUCKETS`` rows come to the driver.

    Every word is a row beside the one after it, so the counting is generated code and not a loop over arrays.
    """
    split = texts.select(words(F.col("text")).alias("w"))
    pairs = split.select(F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))))
    coded = pairs.select(F.crc32("a").alias("a"), F.crc32("b").alias("b"))
    found = (
        coded.select(F.explode(F.array(_one(F.col("a")), _two(F.col("a"), F.col("b")))).alias("term"))
        .where("term IS NOT NULL")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    return {r["term"]: r["n"] for r in found}


def ratios(texts: DataFrame, trusted: DataFrame) -> bytes:
    """Log ratio of each term under the multinomial of ``trusted`` texts and of all, both with one added to every bucket.

    A byte a term, in steps of ``1 / PER_UNIT``, so that it stays small.
    """
    target, raw = _counts(trusted), _counts(texts)
    out = bytearray()
    for first in (0, BUCKETS):
        n_target = sum(target.get(first + i, 0) for i in range(BUCKETS)) + BUCKETS
        n_raw = sum(raw.get(first + i, 0) for i in range(BUCKETS)) + BUCKETS
        for i in range(first, first + BUCKETS):
            x = math.log((target.get(i, 0) + 1) / n_target) - math.log((raw.get(i, 0) + 1) / n_raw)
            out.append(min(max(math.floor(x * PER_UNIT + 0.5) + MIDDLE, 0), 2 * MIDDLE - 1))
    return bytes(out)


def _texts_of(given: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts whose id is among the distinct ``ids``.

    Ids are counted, and broadcast while they take ``BROADCAST_BYTES`` at most.  Beyond that, texts are shuffled to them,
    once: what they leave is written.
    """
    if ids.count() * ID_BYTES <= BROADCAST_BYTES:
        return given.join(F.broadcast(ids), "doc_id", "left_semi")
    return Tables(given.sparkSession, "trusted").write(given.join(ids, "doc_id", "left_semi"))


OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]


def _judged(docs: DataFrame, table: bytes) -> DataFrame:
    text = F.col("text").cast("string")
    # a subquery can't stand in a loop over words; as a column, it can
    cut = docs.drop(*OWN).withColumns({"_words": words(text), "_levels": _levels(docs.sparkSession, table)})
    own = base_columns(text, F.col("_words")) | {"ratio": _mean_ratio(F.col("_words"), F.col("_levels"))}
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return cut.withColumns(own).withColumn("base_failed", failed).drop("_words", "_levels")


def scored(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """``docs`` with the counts of ``base_columns``, ``base_failed``, ``ratio`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of them in repeated three-word windows.  ``ratio``: mean log
    ratio of the text's hashed one- and two-word terms under the multinomial of all trusted documents against that of
    all documents; 0 for a text without words.  ``kept``: not failed, and a ratio not ``DEVIATIONS`` standard deviations
    below the mean of all trusted documents that do not fail.  Without trusted documents every text that does not fail is
    kept.

    A null text is empty.  Rows are judged one by one: repeated rows, null ids and clashing extra columns change
    nothing (own columns replace them); an empty table gives an empty one.  Scans: terms of the trusted, terms of all,
    threshold over the trusted, result.  Only trusted texts meet ids (see ``_texts_of``).
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    trusted = _texts_of(given, ids)
    table = ratios(given, trusted)
    # a filter would be pushed below the projections and split the texts again
    counted = F.when(~F.col("base_failed"), F.col("ratio"))
    mean, spread = _judged(trusted, table).select(counted.alias("r")).agg(F.avg("r"), F.stddev_pop("r")).first()
    lowest = -math.inf if mean is None else mean - DEVIATIONS * spread
    return _judged(docs, table).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(lowest)))
