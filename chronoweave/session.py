"""Session settings, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
_local: dict[str, str] = {}
_cleaned: set[str] = set()


def build(app: str = "chronoweave", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=CONF | more).getOrCreate()


def _remove(app: str, folder: str) -> None:
    """Deletes what cut() wrote in a session, while its JVM is still there."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext.applicationId == app:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df under spark.checkpoint.dir (where unset: the warehouse, or a temporary folder in local mode) and
    reads it back, so that loops do not grow their plan and lost executors cost no recomputation."""
    spark = df.sparkSession
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        local = sc.master.startswith("local[")
        base = _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="chronoweave-")) if local else spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/chronoweave-{sc.applicationId}"
    if sc.applicationId not in _cleaned:
        _cleaned.add(sc.applicationId)
        atexit.register(_remove, sc.applicationId, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
