"""Sessions and the shared folder that jobs cut their lineage in."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the operators rely on; a session made elsewhere may differ and still works.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single machines."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return re.sub(r"^file:/+", "file:///", configured.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = spark.conf.get("millrace.local.dir", None)
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("millrace.local.dir", known)
    return known


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder name for one written result."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared folder and read again; survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(os.path.join(shared_dir(spark), "checkpoints"))
    return df.checkpoint(eager=True)
