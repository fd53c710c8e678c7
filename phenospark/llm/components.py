"""Connected components of a link table, by alternating stars in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import written


#: Nodes of so many neighbours or less are joined by hash; and how many others there can be.
LEAST_HUB, MOST_HUBS = 500, 4000


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """Links each node's larger (large) or smaller neighbours to its smallest one.

    Nodes of more than ``hub`` neighbours, of which there are two links / hub at
    most, are few and are sent to all links; so no task meets all links of a hub.
    The smallest neighbours and the links are written, each by a plan of a few
    shuffles: left to one plan, every use of the links makes them again, and the
    driver holds a plan of dozens of shuffles for each round.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"), "degree")
    least = written(least, "least")
    at = F.col("u") == F.col("n")
    hubs = F.broadcast(least.where(F.col("degree") > hub))
    joined = both.join(hubs, at).unionByName(both.join(hubs, at, "left_anti").join(least.where(F.col("degree") <= hub), at))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return written(out.where(F.col("u") != F.col("v")).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(u, v); root is its component's smallest node.

    Each round's links are written to the shared folder; it ends when a round
    changes nothing, after about the logarithm of the longest path.
    """
    now = written(edges.where(F.col("u") != F.col("v")).distinct(), "edges")
    mark, hub = None, max(LEAST_HUB, 2 * now.count() // MOST_HUBS)
    while True:
        # a small star's links are at most as many as a large one's, and twice these
        now = _star(_star(now, True, hub), False, hub)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
