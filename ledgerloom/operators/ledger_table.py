"""The ledger as a stored table that a batch is merged into where it is.

The table is bucketed by the row key and partitioned by month. A join on the key reads its buckets as they lie, so only
the batch is shuffled. A merge first looks up in which months the batch's rows are (of the key columns only), then
joins these months with the batch and replaces them; the files of all other months stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import drop_partitions
from .ledger import KEY, upsert

MONTH = "ledger_month"


def _month():
    return F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none")).alias(MONTH)


class LedgerTable:
    """A ledger table in a folder. ``buckets`` is fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"ledger_{hashlib.md5(path.encode()).hexdigest()}"
        if not spark.catalog.tableExists(self.name):
            columns = spark.read.parquet(path)._jdf.schema().toDDL()
            keys = ", ".join(KEY)
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY ({MONTH}) CLUSTERED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    @classmethod
    def create(cls, ledger: DataFrame, path: str, buckets: int = 64) -> LedgerTable:
        """Write a ledger as a new table."""
        spark = ledger.sparkSession
        name = f"ledger_{hashlib.md5(path.encode()).hexdigest()}"
        rows = ledger.select("*", _month()).repartition(buckets, *KEY)  # one file for each bucket of a month
        rows.write.mode("errorifexists").format("parquet").partitionBy(MONTH).bucketBy(buckets, *KEY).option("path", path).saveAsTable(name)
        return cls(spark, path, buckets)

    def _table(self) -> DataFrame:
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self._table().drop(MONTH)

    def months_of(self, batch: DataFrame) -> list[str]:
        """Months of the calendar in which rows of the batch are stored, or will be. Reads the key columns, without
        shuffling the table."""
        found = self._table().select(*KEY, MONTH).join(batch.select(*KEY), KEY, "left_semi").select(MONTH)
        return sorted(r[0] for r in found.union(batch.select(_month())).distinct().collect())

    def merged(self, batch: DataFrame, as_of, order: list[str] | None, months: list[str]) -> DataFrame:
        """The rows of these months with the batch applied."""
        old = self._table().where(F.col(MONTH).isin(months)).drop(MONTH)
        return upsert(old, batch, as_of, order).select("*", _month())

    def merge(self, batch: DataFrame, as_of, order: list[str] | None = None) -> None:
        """Apply a batch as ``upsert`` does. It is read twice, so it should be a written table. The files of a month are
        replaced when all new ones are there, so a merge that fails can be repeated."""
        months = self.months_of(batch)
        written = Observation()
        rows = self.merged(batch, as_of, order, months).observe(written, F.collect_set(MONTH).alias("months"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(self.name)
        for month in set(months) - set(written.get["months"]):  # its last row has moved to another month
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({MONTH} = '{month}')")
            drop_partitions(self.spark, self.path, MONTH, lambda value: value == month)
        self.spark.catalog.refreshTable(self.name)
