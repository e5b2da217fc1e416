"""A folder of tables that grows load by load.

Each load writes one folder per table, ``<table>/load=<id>``, and last of all its row in ``commits``. Tables are read up to the
last committed load, so a load that broke off is not there; it runs again with the same number and replaces what it left.
Nothing is compared with what is stored already, whatever its size. One writer at a time; load numbers rise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LoadStore:
    spark: SparkSession
    path: str
    #: Columns of a commit row besides its load.
    commit_ddl: str

    def _folder(self, table: str, load: int) -> str:
        return f"{self.path}/{table}/load={load}"

    def write(self, df: DataFrame, table: str, load: int) -> DataFrame:
        """The rows of one load; what an earlier attempt left is replaced. Returns them as stored."""
        df.write.mode("overwrite").parquet(self._folder(table, load))
        return self.one(table, load, df)

    def one(self, table: str, load: int, like: DataFrame | None = None) -> DataFrame:
        """The rows of one load."""
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self._folder(table, load))

    def commit(self, load: int, **row) -> None:
        names = [c.split()[0] for c in self.commit_ddl.split(", ")]
        done = self.spark.createDataFrame([(load, *(row[n] for n in names))], f"load bigint, {self.commit_ddl}")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/commit={load}")

    def commits(self) -> DataFrame | None:
        """One row per committed load."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.schema(f"load bigint, {self.commit_ddl}").parquet(f"{self.path}/commits/commit=*")

    def last(self) -> Row | None:
        """The commit row of the latest load."""
        done = self.commits()
        return None if done is None else done.orderBy(F.desc("load")).first()

    def read(self, table: str) -> DataFrame | None:
        """All committed rows of ``table``, with the column ``load``; none if there is no load yet."""
        last = self.last()
        if last is None:
            return None
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("load") <= last["load"])
