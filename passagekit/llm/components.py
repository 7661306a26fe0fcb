"""Connected components by alternating large-star and small-star joins.

Both operations are one aggregation and one join over the links, so a hub's
links are counted with partial aggregates and split by skew-join handling; no
vertex's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame) -> DataFrame:
    """For (u, v) rows: every v of a u, and u itself, linked to the least of them."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return (
        _star(both)
        .filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(F.col("m").alias("a"), F.col("v").alias("b"))
        .distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    joined = _star(down)
    moved = joined.filter(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    own = joined.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return moved.unionByName(own).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex of ``links`` (a, b), longs.

    component is the least vertex reachable.  Loops, repeated links and either
    direction are fine; rows with a null end link nothing.  No links: no rows.
    """
    edges = cut(
        links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        edges = cut(_small(_large(edges)), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("b").alias("vertex"), F.col("a").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("vertex"), "component").distinct())
