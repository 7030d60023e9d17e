"""Joins on a line hash when one line may be a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A hash with more than 1/HEAVY_SHARE of all rows is heavy, so there are fewer than HEAVY_SHARE heavy hashes.
HEAVY_SHARE = 1000
# Answers of the heavy hashes are broadcast up to this size, and salted beyond it.
BROADCAST_BYTES = 64 << 20
SALTS = 64


def join_by_hash(
    lines: DataFrame,
    answers: DataFrame,
    key: str = "event_hash",
    copies: str = "copies",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner join of lines with one answer per hash; ``copies`` is the number of lines of each hash.

    Light hashes go through a shuffle join, where no key holds more than 1/HEAVY_SHARE of the rows.  Heavy hashes,
    fewer than HEAVY_SHARE by definition, are joined by broadcast when their answers are small, which is measured.
    Otherwise their lines are spread over salts, and each of their few answers is repeated for every salt.
    """
    total = answers.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("n")).first()["n"]
    is_heavy = F.col(copies) * HEAVY_SHARE > F.lit(total)
    heavy, light = answers.where(is_heavy).drop(copies), answers.where(~is_heavy).drop(copies)
    heavy_keys = F.broadcast(heavy.select(key))
    size = F.sum(F.length(F.to_json(F.struct(*heavy.columns))))
    heavy_chars = heavy.agg(F.coalesce(size, F.lit(0)).alias("n")).first()["n"]
    if 4 * heavy_chars <= broadcast_bytes:
        from_heavy = lines.join(F.broadcast(heavy), key, "inner")
    else:
        salt = F.pmod(F.xxhash64(*[c for c in lines.columns if c != key]), F.lit(SALTS)).cast("int")
        salted = lines.join(heavy_keys, key, "left_semi").withColumn("_salt", salt)
        repeated = heavy.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        from_heavy = salted.join(repeated, [key, "_salt"], "inner").drop("_salt")
    from_light = lines.join(heavy_keys, key, "left_anti").join(light, key, "inner")
    return from_heavy.unionByName(from_light)
