"""Work that can be broken off and taken up again: a log of results, one of failures, and counts of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.sources.documents import read_optional


class Ledger:
    """Results and failures of a job, appended under one folder of the shared file system, each under its key."""

    def __init__(self, spark, place: str, key: str, kind: str):
        self.spark, self.place, self.key, self.schema = spark, place, key, f"`{key}` {kind}, result string, error string"

    def log(self) -> DataFrame:
        return read_optional(self.spark, f"{self.place}/log", self.schema)

    def open(self, rows: DataFrame, again: bool = False) -> DataFrame:
        """Rows that have no result yet; with ``again`` those that failed too."""
        known = self.log().where(F.col("error").isNull()) if again else self.log()
        return rows.join(known.select(self.key), self.key, "left_anti")

    def run(self, rows: DataFrame, work: Callable[[str | None], str], column: str, again: bool = False) -> None:
        """Work on what is open; a call that raises is a failure, and the others go on."""

        key = self.key

        def each(batches):
            import pandas as pd

            for frame in batches:
                out = []
                for k, value in zip(frame[key], frame[column]):
                    try:
                        out.append((k, str(work(value)), None))
                    except Exception as e:  # noqa: BLE001
                        out.append((k, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=[key, "result", "error"])

        self.open(rows, again).select(self.key, column).mapInPandas(each, self.schema).write.mode("append").parquet(f"{self.place}/log")

    def progress(self, rows: DataFrame) -> DataFrame:
        """One row: how many rows there are, are done, have failed and are open."""
        state = self.log().groupBy(self.key).agg(F.max(F.col("error").isNull()).alias("ok"))
        joined = rows.select(self.key).distinct().join(state, self.key, "left")
        return joined.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("open"))
