"""Tables written to the folder the cluster shares, to cut lineage.

``stage`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back, so that later jobs
neither recompute it nor depend on one executor's disk. Only where that setting is absent and the master is this
machine (tests) a folder is made here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-weft-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that nothing else uses."""
    folder = f"{scratch_dir(spark)}/weft-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


def result_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder for results, which ``drop_staged`` leaves alone."""
    return f"{scratch_dir(spark)}/weft-{uuid.uuid4().hex[:12]}/{name}"


def drop_staged(spark: SparkSession) -> int:
    """Delete all that this session has staged, once results that read it are written; how many folders went."""
    for table in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    folders = _MADE.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def stage_bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """Write ``df`` once in buckets of a column: joins and groups by that column then read it without a shuffle.

    The table is registered in the session's catalog under a name of its own, with its files in the scratch folder.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"weft_{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(table)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
