"""Session settings, the shared scratch folder and tables written out between steps."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs an extra exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(master: str | None = None, app_name: str = "forecastops", **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or else the session's warehouse folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


_written: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the program ends or by ``clean_scratch``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder through Spark's own file system layer."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    if path in _written:
        _written.remove(path)


def clean_scratch(spark: SparkSession | None = None) -> None:
    """Delete every scratch table this program has written; results that read them must be finished."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in list(_written):
        remove_path(spark, path)


def _clean_at_exit() -> None:
    try:
        clean_scratch()
    except Exception:  # the JVM may be gone already; what is left lies in the scratch folder only
        pass


atexit.register(_clean_at_exit)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written out once as a table in the shared folder and read back.

    What follows starts from that table: it is not computed again for every reader or after an executor is
    lost, readers take only the columns they need, and plans stay small. ``clean_scratch`` deletes the table.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
