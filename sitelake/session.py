"""Session helpers: local session for tests/bench, checkpoint folder, materialized tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Compiled selector steps that are taken through the driver as a local relation; more stay a written table.
BROADCAST_ROW_LIMIT = 1_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "sitelake") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session.

    Uses the folder the cluster names in ``spark.checkpoint.dir``. Only when it is
    unset and the master is local (tests, bench) is a scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; lineage cuts need it")
    path = tempfile.mkdtemp(prefix="sitelake-ckpt-", dir=os.environ.get("SITELAKE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` once as parquet under the checkpoint folder and read it back.

    One job (compute + write) instead of the two of ``Dataset.checkpoint``; the
    files live in the shared folder named by ``spark.checkpoint.dir`` (never a
    machine-local folder on a cluster), so later stages survive executor loss.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/sitelake-{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.parquet(path)
    out.sitelake_path = path  # for release()
    return out


class Bucketed:
    """A table bucketed by one column in the shared folder: appended to, joined on that column without moving, dropped at the end."""

    def __init__(self, spark: SparkSession, schema: str, column: str, label: str):
        import uuid

        self.spark, self.column = spark, column
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{self.name}"
        spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet CLUSTERED BY ({column}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def add(self, rows: DataFrame) -> None:
        rows.repartition(self.buckets, self.column).write.insertInto(self.name)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads (others are left alone)."""
    for df in tables:
        path = getattr(df, "sitelake_path", None)
        if path:
            jpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
