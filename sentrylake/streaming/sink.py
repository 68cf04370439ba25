"""A sink of alerts that keeps one row for each (actor, tier, step), whatever is run again.

A batch writes its own folder and then a row into a ledger of (query, batch). A batch that the ledger has is left out. One that
died between the two is written anew over its own folder, and rows are compared with the other batches' only, so that its own
rows don't stand against it. Alerts that another query, or an earlier batch, has put down are left out by an anti-join of the
steps that the batch has.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("actor_id", "tier", "step")
_LEDGER = "query string, batch long"


class AlertSink:
    """Alerts under a folder; query: the name of what writes them. Names and numbers may come again after a restart."""

    def __init__(self, folder: str, query: str, crash: bool = False):
        self.folder, self.query, self.crash = folder, query, crash

    def _read(self, spark: SparkSession, part: str, schema) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        except AnalysisException:  # nothing has been written yet
            return spark.createDataFrame([], schema)

    def put(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        spark = batch.sparkSession
        if not self._read(spark, "ledger", _LEDGER).filter((F.col("query") == self.query) & (F.col("batch") == number)).isEmpty():
            return
        own = f"{self.query}-{number}"
        there = self._read(spark, "alerts", f"{', '.join(f'{n} {t}' for n, t in batch.dtypes)}, written string").filter(F.col("written") != own)
        batch = batch.dropDuplicates(list(KEY)).persist()
        steps = batch.agg(F.min("step").alias("low"), F.max("step").alias("high")).first()
        if steps["low"] is not None:
            there = there.filter(F.col("step").between(steps["low"], steps["high"]))
        batch.join(there.select(*KEY), [*KEY], "left_anti").write.mode("overwrite").parquet(f"{self.folder}/alerts/written={own}")
        batch.unpersist()
        if self.crash:
            raise RuntimeError("stopped before the ledger")
        spark.createDataFrame([(self.query, number)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def rows(self, spark: SparkSession, schema: str) -> DataFrame:
        return self._read(spark, "alerts", schema)
