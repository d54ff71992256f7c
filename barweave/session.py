"""Session defaults used by the tests, the bench and local runs.

On a cluster the submitter's own settings win: nothing here is needed for the
operators to work, apart from a UTC session time zone for naive timestamps.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SPLIT_SETTING, SPLIT_DEFAULT, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", "134217728", "32m"


def tune(spark: SparkSession) -> SparkSession:
    """Run-time settings the plans profit from; safe to set on any session.

    The JVM never compiles methods above 8000 bytes of bytecode, so a fused stage
    with a larger method would run interpreted. With this limit Spark splits such a
    stage into smaller compiled functions instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # naive timestamps of the tables are UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # a map task aggregates its whole split before the shuffle, mostly rows with keys of their own: smaller
    # splits bound its memory whatever the input; another value set by the submitter stays
    if spark.conf.get(SPLIT_SETTING).rstrip("b") == SPLIT_DEFAULT:
        spark.conf.set(SPLIT_SETTING, SPLIT_BYTES)
    return spark


def local_session(cores: int = 8, memory: str = "16g", partitions: int = 8) -> SparkSession:
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # call-site capture costs more than planning when plans are built from many columns
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    return tune(session)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used when the session has it.
    Only a local master may fall back to a machine-local folder.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="barweave-")
        spark.conf.set(CHECKPOINT_SETTING, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
