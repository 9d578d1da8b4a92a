"""The vector collection as a versioned Parquet folder with a fixed schema.

Inserts append files. A delete or a compaction writes a new ``version=N`` folder next to the
old one, so a job that is lost half-way leaves the last whole version readable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.operators.records import delete_ids, new_rows


@dataclass(frozen=True)
class VectorTable:
    spark: SparkSession
    path: str

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        root, fs = self._fs()
        if not fs.exists(root):
            return -1
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(root)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        whole = [int(n.split("=")[1]) for n, p in names if n.startswith("version=") and fs.exists(done(p, "_SUCCESS"))]
        return max(whole, default=-1)

    @staticmethod
    def _shaped(rows: DataFrame) -> DataFrame:
        """The table's columns; those that the rows lack are null."""
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in schemas.VECTOR_RECORD])

    def _write(self, rows: DataFrame) -> None:
        self._shaped(rows).write.mode("overwrite").parquet(f"{self.path}/version={self._version() + 1}")

    def create(self) -> "VectorTable":
        """Create the collection unless it is there."""
        if self._version() < 0:
            self._write(self.spark.createDataFrame([], schemas.VECTOR_RECORD))
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(schemas.VECTOR_RECORD).parquet(f"{self.path}/version={self._version()}")

    def insert(self, rows: DataFrame, unique: bool = False) -> None:
        """Plain append keeps duplicates; ``unique`` leaves out records that are there already.

        Records are the same if their text, source and chunk number are: an id is a short digest
        of the text, and equal texts of two sources, or two texts that share an id, both stay.
        """
        rows = self._shaped(rows)
        if unique:
            same = ["_digest", "source", "chunk_index"]
            digest = F.sha2("text", 256).alias("_digest")
            rows = new_rows(self.read().select("source", "chunk_index", digest), rows.select("*", digest), same).drop("_digest")
        rows.write.mode("append").parquet(f"{self.path}/version={self._version()}")

    def delete(self, ids: DataFrame) -> int:
        """Drop the listed ids; returns how many were asked for."""
        asked = ids.count()
        self._write(delete_ids(self.read(), ids, "id"))
        return asked

    def count(self) -> int:
        return self.read().count()

    def compact(self, files: int) -> None:
        """Rewrite many small files as a few."""
        self._write(self.read().repartition(files, F.col("id")))
