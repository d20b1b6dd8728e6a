"""Session settings, the shared folder and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Defaults for a session that this package starts itself (tests, bench).
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    conf = LOCAL_CONF | {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(partitions),
    }
    spark = SparkSession.builder.config(map=conf | extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders that this process made below the shared folder.
_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session may go
    without it; a temporary folder is then set. What is written there stays until ``release``, as
    frames may still read it. A cluster session without it is an error,
    as a machine-local folder would not be readable from other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quiverlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/quiverlake/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process wrote; frames read from them end."""
    while _made:
        delete_path(spark, _made.pop())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """Shuffle partitions for so many rows: the session's number, or more, to hold about ``each``."""
    return max(shuffle_partitions(spark), -(-rows // each))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for several reads."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
