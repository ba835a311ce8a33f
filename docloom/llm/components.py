"""Connected components of a graph given by its links, by alternating star contraction.

Each round hangs every node on the smallest node it can see, first along larger neighbours, then along smaller ones,
until every link joins a node to the smallest node of its component. Nodes are longs. A round moves pairs of longs
only; minima are aggregated before the shuffle, and the join back to a hub's links can be split where it is skewed.
A round is one job, whose result is written to the shared folder, so a lost executor never costs more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise


def _settled(links: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(links.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not seen.where((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") == 1))).limit(1).count()


def component_roots(links: DataFrame) -> DataFrame:
    """From links (u, v): one row (v, root) for each node that isn't itself the smallest of its component.

    Null ends, loops and repeated links are ignored.
    """
    current = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _settled(current):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        sideways = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = materialise(sideways.union(below.select("u", F.col("m").alias("v"))).distinct(), "links")
    return current.select(F.col("u").alias("v"), F.col("v").alias("root"))
