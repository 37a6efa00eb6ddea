"""Node table as a stored, bucketed table (for pipelines that run many jobs over the same pages).

``shred`` persists its result for the life of one job. At scale the node table is
worth writing once: bucketed by page_id in the shared checkpoint/warehouse folder,
every later join, window or aggregate on page_id reads co-partitioned buckets
without any shuffle, and the table survives executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def save_node_table(nodes: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Write ``nodes`` as table ``name`` bucketed and sorted by page_id (``buckets`` files per write task group).

    ``path`` defaults to a folder under the session's checkpoint directory (a shared
    folder on a cluster).
    """
    spark = nodes.sparkSession
    where = path or ensure_checkpoint_dir(spark).rstrip("/") + f"/sitelake-nodes-{name}"
    nodes.write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id", "node_id") \
        .option("path", where).saveAsTable(name)


def load_node_table(spark: SparkSession, name: str) -> DataFrame:
    """The stored node table; joins and aggregates keyed on page_id use its buckets (no exchange)."""
    return spark.read.table(name)
