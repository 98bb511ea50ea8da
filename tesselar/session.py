"""Session set-up shared by tests, the bench and scripts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application, through the driver's file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tesselar-")) / "tesselar.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, Path(here.name) / source.relative_to(here))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def local_session(cores: int | str = 8, app: str = "tesselar", **extra: str) -> SparkSession:
    """A local session with the settings that the queries are written for.

    On a cluster the caller's session is used as it is; only the time zone has
    to be UTC for results that show timestamps.
    """
    conf = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast, its number of rows checked first: meant for tables that are fixed."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table meant to be fixed has over {most} rows; it would be broadcast")
    return F.broadcast(df)
