"""Written intermediates in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWNED: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its machine; on a
    cluster, whose executors would not see that, it is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tesselar-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver's program ends, or by ``clear``."""
    app = spark.sparkContext.applicationId
    if app not in _OWNED:
        _OWNED[app] = spark, f"{shared_dir(spark)}/tesselar/{app}"
    return _OWNED[app][1]


def clear(spark: SparkSession) -> None:
    """Remove what this application has written as intermediates; frames that read them can't be used any more."""
    app = spark.sparkContext.applicationId
    if app in _OWNED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_OWNED.pop(app)[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear_all() -> None:
    for spark, _ in list(_OWNED.values()):
        try:
            clear(spark)
        except Exception:  # noqa: BLE001  (the JVM is gone already)
            pass


def place_for(spark: SparkSession, name: str) -> str:
    """A path of its own for an intermediate."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared folder and read it back.

    Cuts the lineage and keeps costly steps from running again (a range
    partitioning samples its input first). Lost executors don't matter: the
    files are not theirs.
    """
    spark = df.sparkSession
    path = place_for(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, key: str):
    """``df`` written once, dealt and sorted by ``key``: joins on it neither send nor sort it again. It is gone at the end of the block."""
    spark = df.sparkSession
    path, table = place_for(spark, name), f"{name}_{uuid.uuid4().hex}"
    # as many as a shuffle has, else a join would deal it anew
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
