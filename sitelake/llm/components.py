"""Connected components of a link table by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.shared import Written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each linked node can reach; nodes without links do not appear.

    Every round takes the smallest label among the neighbours and then the label of that label, so long chains halve.
    Labels are written to the shared folder each round and the round before is deleted. A hub's edges are joined in
    splits (AQE) and reduced by a partial minimum, never gathered.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    edges = Written(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges").df
    now = Written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("comp")), "labels")
    while True:
        near = edges.join(now.df.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        lower = now.df.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        jump = now.df.select(F.col("node").alias("via"), F.col("comp").alias("beyond"))
        after = Written(lower.join(jump, "via").select("node", "old", F.least("via", "beyond").alias("comp")), "labels")
        moved = not after.df.where("comp <> old").isEmpty()
        now.drop()
        now = after
        if not moved:
            return now.df.select("node", "comp")
