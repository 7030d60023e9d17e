"""Connected components by joins: vertices hook to smaller ones, level by level, and leave the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.tables import Tables


def _spread(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours get its smallest neighbour (itself included) as theirs."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _hooks(edges: DataFrame) -> DataFrame:
    """``(a, m, inner)``: each vertex with smaller neighbours, the smallest of them, and whether it has larger ones."""
    ends = edges.select("a", "b", F.lit(False).alias("inner")).unionByName(
        edges.select(F.col("b").alias("a"), F.lit(None).alias("b"), F.lit(True).alias("inner"))
    )
    return ends.groupBy("a").agg(F.min("b").alias("m"), F.max("inner").alias("inner")).where("m IS NOT NULL")


def _gather(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    """Each vertex's smaller neighbours get the smallest of these as theirs, and so does it if it has larger ones.

    A vertex without larger neighbours is left with its hook alone, which is not among the links returned.
    """
    moved = edges.join(hooks.select("a", "m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(hooks.where("inner").select("a", F.col("m").alias("b")))


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """``(node, root)`` for every vertex of ``links (a, b)``: the root is the smallest vertex that can be reached.

    Alternates the two contractions.  A vertex that is left with one link, to a smaller vertex, leaves the graph with it
    and takes that one's root at the end, so a level holds only what the levels before have not settled, and the work is
    done when nothing is left; the largest vertex of each component leaves in every level.  Every level is written, so a
    lost executor repeats one level at most.  A vertex with very many links is an ordinary key of aggregations with
    partial sums and of joins whose skewed side is split.  Self links and nulls are ignored; without links the result is
    empty.
    """
    edges = tables.write(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    levels = []
    while True:
        hooks = tables.write(_hooks(edges))
        rest = tables.write(_gather(edges, hooks).distinct())
        tables.drop(edges)
        levels.append(hooks)
        if rest.isEmpty():
            break
        edges = tables.write(_spread(rest).distinct())
        tables.drop(rest)
    roots = None
    for hooks in reversed(levels):
        left = hooks.where("NOT inner").select(F.col("a").alias("node"), F.col("m").alias("root"))
        if roots is None:
            roots = left
            continue
        known = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        settled = tables.write(left.join(known, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        tables.drop(hooks)
        roots = roots.unionByName(settled)
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
