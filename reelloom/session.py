"""Session settings, table access and materialised intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}

_written: list[tuple[SparkSession, str]] = []


def session(master: str = "local[8]", app: str = "reelloom", **extra: str) -> SparkSession:
    """A session with the settings the library is tested under."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_small(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows and
    these, as text, at most ``most_bytes``."""
    size = F.octet_length(F.to_json(F.struct("*")))
    rows, held = df.limit(most_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if rows <= most_rows and (held or 0) <= most_bytes else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the session's ``spark.checkpoint.dir``. Only a local master may do
    without the setting; there a temporary folder takes its place.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="reelloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/reelloom-{label}-{uuid.uuid4().hex}"
    if not _written:
        # Registered after the session's own hook, so it runs before the session ends.
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    The table cuts the lineage, survives lost executors, and is read by
    column; it is removed when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            remove_path(spark, path)
        except Exception:  # the session has ended already
            pass
