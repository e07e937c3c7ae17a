"""Connected components of a table of links, by rounds of large-star and small-star joins.

No node's links are ever gathered: a round takes minima with partial aggregation and sort-merge joins, which Spark
splits where a node has very many links, as the minima are written before they are joined. Each round's links are
written to the shared folder, too, which cuts lineage and survives lost executors. The driver sees a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = written(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved)


def _down(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(links: DataFrame, what: str = "links") -> DataFrame:
    """node and component (the least node that links reach) for each node of `links` (u, v; of one ordered type).

    Nodes without links to others are not in it. Repeated links and links to oneself are as good as one and none; rows
    with nulls are left out. An empty table gives no rows.
    """
    now = written(_down(links.where("u IS NOT NULL AND v IS NOT NULL")), what)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
        now = written(_down(_small_star(written(_down(_large_star(now)), what))), what)
