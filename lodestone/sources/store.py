"""A keyed store of rows in Parquet: versioned appends, of which the last counts. It serves the cache of answers and the log of calls.

Layout: ``generation=<g>/version=<v>/``. A put writes one version whole; the same version put again replaces itself, so a job that is run again leaves no second copy. A read takes,
of each key, the row of the highest version, then of the highest place in it. Compaction writes the last rows as the only version of the next generation; readers
use the newest generation that is complete, so one that runs meanwhile sees the old one or the new one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Store:
    """schema: the rows' fields, ``key`` among them. disabled: nothing is read or written; no_read: nothing is read."""

    spark: SparkSession
    folder: str
    schema: str = "key string, text string"
    disabled: bool = False
    no_read: bool = False

    def _generations(self) -> list[int]:
        """Complete generations, by any file system that Spark reads. The first is complete as it is; others once their compaction has ended."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        found = sorted(int(n.partition("=")[2]) for n in names if n.startswith("generation="))
        done = lambda g: any(fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/generation={g}/{n}")) for n in ("_COMPACTED", "version=0/_SUCCESS"))
        return [g for g in found if g == 0 or done(g)]

    def _now(self) -> int:
        return max(self._generations(), default=0)

    def put(self, rows: DataFrame, version: int, *order: Column) -> None:
        """Write rows as a version (1 or more). Within it the last in order stands for a key: by ``order``, else by the fields themselves."""
        if self.disabled:
            return
        if version < 1:
            raise ValueError("versions begin at 1")
        fields = T.StructType.fromDDL(self.schema).names
        place = F.struct(*(order or (F.col(f) for f in fields)))
        each = F.struct(*fields)
        last = rows.groupBy("key").agg(F.max_by(each, place).alias("row")).select("row.*")
        last.write.mode("overwrite").parquet(f"{self.folder}/generation={self._now()}/version={version}")

    def all(self) -> DataFrame:
        """The last row of each key."""
        generations = [] if self.disabled or self.no_read else self._generations()
        if not generations:
            return self.spark.createDataFrame([], self.schema)
        fields = T.StructType.fromDDL(self.schema).add("version", T.LongType())
        rows = self.spark.read.schema(fields).option("recursiveFileLookup", "false").parquet(f"{self.folder}/generation={max(generations)}")
        return rows.groupBy("key").agg(F.max_by(F.struct(*fields.names[:-1]), "version").alias("row")).select("row.*")

    def get(self, requests: DataFrame) -> DataFrame:
        """requests(key, ...) with the stored fields, null where there is none; a row a request, however often its key was put."""
        return requests.join(self.all(), "key", "left")

    def compact(self) -> None:
        """Last rows alone, as version 0 of the next generation."""
        if self.disabled or not self._generations():
            return
        now = self._now()
        Store(self.spark, self.folder, self.schema).all().write.mode("overwrite").parquet(f"{self.folder}/generation={now + 1}/version=0")
