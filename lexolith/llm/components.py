"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexolith.llm.common import checkpointed

#: Far more than any path that fits a table takes: edges turn into stars within about the logarithm of its length.
MOST_ROUNDS = 60
#: Edges that one task handles in a round, about.
EDGES_PER_TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: long): root is the least vertex that links reach from v.

    Each round joins every vertex's neighbours to the least of them (large star), then its lesser neighbours (small
    star); edges turn into a star around each root within about the logarithm of the longest path. Rounds are
    checkpointed; a row for each edge is all that moves. Loops are left out, so a vertex without other neighbours has
    no row.
    """
    # tasks follow the edges: rounds over a short list of links stay a few tasks, however many partitions shuffles have
    tasks = max(1, -(-edges.count() // EDGES_PER_TASK))

    def settled(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.filter("v <> root").coalesce(tasks).distinct().coalesce(tasks))

    stars = settled(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root")))
    before = None
    for _ in range(MOST_ROUNDS):
        # nothing changes any more when the edges have the same number and the same sum of hashes
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return stars
        before = now
        both = stars.unionByName(stars.select(F.col("root").alias("v"), F.col("v").alias("root")))
        least = both.groupBy("v").agg(F.min("root").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.filter("root > v").join(least, "v").select(F.col("root").alias("v"), F.col("m").alias("root"))
        large = settled(large.unionByName(least.select("v", F.col("m").alias("root"))))
        low = large.groupBy("v").agg(F.min("root").alias("m"))
        small = large.join(low, "v").select(F.col("root").alias("v"), F.col("m").alias("root"))
        stars = settled(small.unionByName(low.select("v", F.col("m").alias("root"))))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
