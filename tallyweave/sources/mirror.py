"""Keyed tables kept in a folder: every change writes a new version, and readers only see whole ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import inserted_missing, replaced_groups, upsert


class Mirror:
    """A table in ``folder/v=N``; the version counts once Spark has written its ``_SUCCESS`` mark.

    A change reads the last whole version and writes the next one, so a run that dies leaves the
    table as it was, and running it again does no harm: all changes are by key.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._path = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder, *x]))
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last whole version; 0 if there is none."""
        root = self._path()
        if not self._fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and self._fs.exists(self._path(n, "_SUCCESS"))]
        return max(found, default=0)

    def read(self) -> DataFrame:
        v = self.version()
        if not v:
            raise FileNotFoundError(f"no version in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v={v}")

    def write(self, df: DataFrame, keep: int = 2) -> DataFrame:
        """Write a new version, drop those before the last ``keep``, and read it."""
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v={v}")
        for old in range(max(1, v - keep - 1), v - keep + 1):
            self._fs.delete(self._path(f"v={old}"), True)
        return self.read()

    def _change(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return self.write(f(self.read()))

    def upsert(self, source: DataFrame, keys: Sequence[str], order: Sequence[Column], nulls: str = "keep") -> DataFrame:
        return self._change(lambda t: upsert(t, source, keys, order, nulls))

    def replace_groups(self, source: DataFrame, group: str, touched: DataFrame) -> DataFrame:
        return self._change(lambda t: replaced_groups(t, source, group, touched))

    def insert_missing(self, source: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
        return self._change(lambda t: inserted_missing(t, source, keys, order))

    def append(self, rows: DataFrame) -> DataFrame:
        return self._change(lambda t: t.unionByName(rows.select(*t.columns)))


def preview(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """What an upsert would do, by kind (``insert``, ``update``, ``same``) and number, without writing."""
    old = target.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__there"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}")))
    kind = F.when(F.col("__there").isNull(), "insert").when(differs, "update").otherwise("same")
    return source.join(old, list(keys), "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
