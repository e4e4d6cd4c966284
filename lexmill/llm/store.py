"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder; only where it is unset (tests, a laptop) a folder of our own is used.
Rows here are whole documents. Spark bounds the Arrow batches that workers get by rows and by bytes
(``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless set), so the operators change no setting of the session.
Tables are Parquet written by Spark's committer, so a lost executor costs a task retry and never a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans.scratch import clear, delete, shared_folder

__all__ = ["Scratch", "clear"]
#: Parquet looks at the bytes of a row group and a page after 100 rows first, if not told otherwise: 6 GB of texts of 60 MB.
TEXTS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}


class Scratch:
    """Tables of one operator run. ``cut`` writes and rereads one, which ends its lineage; ``drop`` deletes one early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, shared_folder(spark, label)

    def cut(self, df: DataFrame, name: str, texts: bool = False) -> DataFrame:
        """``texts``: rows hold whole texts, which may be long, so row groups and pages are bounded by bytes from the first row on."""
        path = f"{self.root}/{name}"
        df.write.options(**TEXTS if texts else {}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")
