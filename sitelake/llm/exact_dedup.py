"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text, in the shared folder. A batch is
reduced to its own distinct digests first (partial aggregation, so a group of copies never meets in one task), compared
with the index by a sort-merge anti-join on co-partitioned buckets, and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.shared import cut, shared_path


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256) per row: SHA-256 (hex) of the UTF-8 text with A-Z lower-cased; null text counts as empty."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            out = [hashlib.sha256((t.as_py() or b"").lower()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text_sha256"])

    id_type = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(digest, f"doc_id {id_type}, text_sha256 string")


class DigestIndex:
    """Persistent index of the texts seen so far: (digest, keep_id), bucketed and sorted by digest.

    ``path`` holds ``data`` (the bucketed table) and ``meta`` (its bucket count), so a later session that opens the
    same path goes on where the last one ended. ``buckets`` counts for a new index only; the default is the session's
    number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        meta = jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        if meta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(meta):
            row = spark.read.parquet(f"{path}/meta").first()
            self.buckets, self.id_type = row["buckets"], row["id_type"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.id_type = id_type
            spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(id_type).alias("id_type")).write.parquet(f"{path}/meta")
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id {self.id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/data'"
        )

    def entries(self) -> DataFrame:
        """Every entry, as the bucketed table."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        """Every entry, read without the buckets, so that a join on hot digests can be split by AQE."""
        return self.spark.read.schema(f"digest string, keep_id {self.id_type}").parquet(f"{self.path}/data")

    def add(self, batch: DataFrame) -> DataFrame:
        """Append the digests of ``batch`` (digest, keep_id; one row per digest) that are new; returns those rows."""
        spread = batch.select("digest", "keep_id").repartition(self.buckets, "digest")
        known = self.entries().select("digest").hint("merge")
        new = cut(spread.join(known, "digest", "left_anti"), "new-digests")
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        return new


def group_digests(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): the largest id and the rows of each digest."""
    return digests.groupBy(F.col("text_sha256").alias("digest")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def dedup_report(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``docs`` to the index and say for every row which row of its text stays.

    Result, one row per input row: doc_id, keep_id, group_size, kept, text_sha256. A text that the index held before
    this batch keeps that earlier id and no row of the batch is kept; of new equal texts the row with the largest id
    stays. Null and empty texts are equal. Rows that repeat the same id and text: one is kept. Null ids: they stay
    only where no row of the text has an id (keep_id is null then). An empty table gives an empty result. Other
    columns are not read.
    """
    digests = cut(text_digests(docs, id_col, text_col), "digests")
    groups = cut(group_digests(digests), "digest-groups")
    added = index.add(groups)
    fresh = added.select("digest", F.lit(True).alias("fresh"))
    labels = index.files().join(groups.select("digest", "group_size"), "digest").join(fresh, "digest", "left")
    rows = digests.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumnRenamed("text_sha256", "digest").join(cut(labels, "digest-labels"), "digest")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    kept = F.col("fresh").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay (rules of ``dedup_report``), with all their columns.

    The join key holds the id beside the digest, so the copies of one text spread over all tasks.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, shared_path(spark, "digest-index"), id_type=docs.schema[id_col].dataType.simpleString())
    keys = cut(text_digests(docs, id_col, text_col), "digests")
    winners = index.add(cut(group_digests(keys), "digest-groups")).select("digest", "keep_id")
    marked = docs.select(F.struct("*").alias("row")).select("row", F.sha2(ascii_lower(f"row.{text_col}"), 256).alias("digest"))
    joined = marked.join(winners, (marked["digest"] == winners["digest"]) & marked[f"row.{id_col}"].eqNullSafe(winners["keep_id"]), "left_semi")
    return joined.withColumn("row_id", F.col(f"row.{id_col}")).dropDuplicates(["digest", "row_id"]).select("row.*")


def ascii_lower(col: str):
    """UTF-8 text (null as empty) with A-Z lower-cased and nothing else."""
    return F.translate(F.coalesce(F.col(col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
