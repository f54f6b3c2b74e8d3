"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the jobs rely on.  Skewed joins that are not salted by hand
# are split by the adaptive planner, also when that costs one more shuffle.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Bytes of Parquet, or of a shuffle, that one task gets at most.  Both are compressed: ids, dates and account names take
# twenty times as much in a task's sorts and hash tables.  A session's own smaller values stay.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 8 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
    # What a file counts besides its size, so that a task gets some hundred small files and not thirty.
    "spark.sql.files.openCostInBytes": 64 << 10,
}
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def _bytes(setting: str) -> int:
    """Bytes of a setting like `64MB`."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(number) * _UNITS[unit]


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for name, value in ADAPTIVE.items():
        spark.conf.set(name, value)
    for name, most in TASK_BYTES.items():
        if _bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates, from `spark.checkpoint.dir`.

    A folder of our own is made only where the setting is missing and the master
    is local (tests, laptops); on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="spark-shutterlake-", dir="/tmp")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/shutterlake/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The result survives lost executors, has no lineage, and carries real sizes,
    so later joins are planned from facts.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one folder made by `fresh_path`."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage: only then does Spark remove the shuffle files of finished jobs."""
    spark._jvm.System.gc()
