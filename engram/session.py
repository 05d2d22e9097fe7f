"""Session defaults and the shared scratch folder.

``materialize`` cuts lineage by writing Parquet under ``spark.checkpoint.dir``,
the one folder that the driver and every executor share on a cluster, so a lost
executor never loses the data.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "engram", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, AQE)."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return builder.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a local one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "checkpoints", "engram")
        spark.conf.set("spark.checkpoint.dir", where)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


_cleaning: set[str] = set()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/engram-{spark.sparkContext.applicationId}"
    if root not in _cleaning:
        _cleaning.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one scratch table that no later plan reads."""
    _remove(spark, path)


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (same schema)."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which no later plan may read."""
    if getattr(df, "_scratch", None):
        drop_path(df.sparkSession, df._scratch)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` in bytes (file sizes for scans), at least 1."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(1, int(str(size)))
