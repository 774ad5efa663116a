"""Connected components by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from runloom.llm.stage import staged


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex in ``links`` (a, b); the smallest vertex names a component.

    Each round hooks every vertex to its smallest neighbour and contracts the
    links along two hooks. Labels only fall, so a round merges at least every
    second vertex of what is left; a star takes one. Every table of a round is
    written, so joins have two plain sides that Spark can split where a vertex
    has very many links.
    """
    links = staged(links.filter("a <> b").select("a", "b"), "links")
    roots = _both(links).select(F.col("a").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    while not links.isEmpty():
        hooks = _both(links).groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        hooks = staged(hooks, "hooks")
        ends = links
        for end in ("a", "b"):
            ends = _along(_along(ends, end, hooks), end, hooks)
        links = staged(ends.filter("a <> b").select("a", "b").distinct(), "links")
        roots = staged(_along(_along(roots, "component", hooks), "component", hooks), "roots")
    return roots


def _along(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """Replace a vertex by what it hooks to."""
    steps = hooks.select(F.col("a").alias(column), F.col("to").alias("_to"))
    return rows.join(steps, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _both(links: DataFrame) -> DataFrame:
    return links.union(links.select("b", "a"))
