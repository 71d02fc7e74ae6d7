"""Session helpers: local session for tests and bench, checkpoint folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cpus: str = "*", app: str = "quern", shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names in
    ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="quern-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Rows of a counted lookup table that go to every task; more meet by a shuffle.
FEW_ROWS = 100_000


def by_document(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of a document in one task, over as many tasks as the session shuffles to: what is grouped, joined or
    ordered by document afterwards needs no further shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def kept_by_document(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows in compressed files of the shared folder, a file for each task of ``by_document``, which finds them dealt already: what is
    grouped or joined by document reads no more than the columns it needs and shuffles nothing."""
    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    by_document(df, key).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def small(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A lookup table, computed and counted once; one of up to ``most`` rows is sent to the other side's tasks."""
    kept = cut_lineage(table)
    return F.broadcast(kept) if kept.count() <= most else kept


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
