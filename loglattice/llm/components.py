"""Connected components by contraction, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import attach
from loglattice.session import cut_lineage


def label(node: Column) -> Column:
    """The name a long goes by here: XXH64 of eight bytes, which maps longs one to one onto longs.

    Names without order along paths keep the number of rounds logarithmic.
    """
    return F.xxhash64(node)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: non-null longs) to one row per node: ``node`` (its :func:`label`), ``root`` (the label of its component).

    Every round each node picks its smallest neighbour or itself and is replaced by its pick; edges
    inside a pick vanish, repeated edges fall together, so the graph shrinks geometrically until no
    edge is left. The picks of all rounds are then followed from the last to the first. Picks are
    made with map-side minima; nodes with a large share of the edges are joined by broadcast
    (:func:`attach`).
    """
    edges = cut_lineage(edges.filter("a <> b").select(label(F.col("a")).alias("a"), label(F.col("b")).alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        picks = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
                            .select("node", F.least("node", "low").alias("pick"), "n"))
        rounds.append(picks.select("node", "pick"))
        for end in ("a", "b"):
            edges = cut_lineage(attach(edges.withColumnRenamed(end, "node"), picks.withColumnRenamed("pick", end), "node", "n").select("a", "b"))
        edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds[-1].withColumnRenamed("pick", "root")
    for picks in reversed(rounds[:-1]):
        followed = attach(picks.withColumnRenamed("pick", "mid"), _counted(picks, labels), "mid", "n")
        labels = cut_lineage(followed.select("node", F.coalesce("root", "mid").alias("root")))
    return labels


def _counted(picks: DataFrame, labels: DataFrame) -> DataFrame:
    """Roots by ``mid`` with the number of nodes that picked it."""
    uses = picks.groupBy(F.col("pick").alias("mid")).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(uses.join(labels.select(F.col("node").alias("mid"), "root"), "mid", "left"))
