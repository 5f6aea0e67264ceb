"""Keyed tables in Parquet folders, replaced as a whole by writing beside and switching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import tables


class Store:
    """A folder of versions; the highest number is the table. Readers of an older version aren't disturbed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def versions(self) -> list[int]:
        fs, folder = self._fs()
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(done(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.versions()[-1]}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None, sizes: dict[str, int] | None = None) -> None:
        """A new version; a failed write leaves no _SUCCESS and so no version. sizes: of vector columns; a vector of another size (null ones aside) fails the write."""
        now = self.versions()
        for column, size in (sizes or {}).items():
            df = df.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == size), F.col(column)).otherwise(F.raise_error(F.lit(f"{column} has not {size} values"))))
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{(now[-1] if now else 0) + 1}")

    def upsert(self, new: DataFrame, key: str, sizes: dict[str, int] | None = None) -> None:
        self.write(tables.upsert(self.read(), new, key) if self.versions() else new, sizes=sizes)

    def delete(self, keys: DataFrame, key: str) -> None:
        self.write(tables.delete(self.read(), keys, key))

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest versions."""
        fs, _ = self._fs()
        for v in self.versions()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{v}"), True)
