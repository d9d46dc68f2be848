"""The stored points of a collection, one Parquet partition a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import point_id
from loamgraph.operators.vectors import checked
from loamgraph.plans.shared import children, remove

SCHEMA = "id string, vector array<float>, folder string, rel_path string, abs_path string, chunk_index int, content string, source string"


def make_points(chunks: DataFrame, folder: str, root: str = "", source: str = "ingest") -> DataFrame:
    """Points of (path, chunk_index, content, vector) rows; the id follows from folder, path and index."""
    key = F.concat(F.lit(folder + ":"), F.concat_ws("#", "path", "chunk_index"))
    return chunks.select(point_id(key).alias("id"), "vector", F.lit(folder).alias("folder"), F.col("path").alias("rel_path"), F.concat(F.lit(root), "path").alias("abs_path"), "chunk_index", "content", F.lit(source).alias("source"))


class Collection:
    """A folder of Parquet files partitioned by ``folder``, which a filter on it prunes."""

    def __init__(self, spark: SparkSession, path: str, dims: int):
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims

    def ensure(self) -> Collection:
        if not children(self.spark, self.path):
            self.spark.createDataFrame([], SCHEMA).write.partitionBy("folder").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def replace_folder(self, points: DataFrame, folder: str | None = None) -> None:
        """Write points over those of their folders; other folders stay, and a failure leaves the old ones.

        With ``folder``, all points are of it, and without any points it is emptied."""
        checked(points, "vector", self.dims).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(self.path)
        if folder is not None and not points.limit(1).count():
            self.delete_folder(folder)

    def _rewrite(self, kept: DataFrame, points: DataFrame) -> None:
        staged = f"{self.path}-staged-{uuid.uuid4().hex}"
        kept.unionByName(points.select(kept.columns)).write.parquet(staged)
        self.replace_folder(self.spark.read.schema(SCHEMA).parquet(staged))
        remove(self.spark, staged)

    def upsert(self, points: DataFrame) -> None:
        """Add points, replacing those of the same id, in the folders they are in."""
        folders = points.select("folder").distinct()
        old = self.read().join(folders, "folder", "left_semi").join(points.select("id"), "id", "left_anti")
        self._rewrite(old.select(*self.read().columns), points.dropDuplicates(["id"]))

    def replace_paths(self, points: DataFrame, paths: DataFrame, folder: str) -> None:
        """Put ``points`` in the place of all points of the ``paths`` (path) of a folder, so that a file may shrink or go."""
        old = self.read().where(F.col("folder") == folder)
        kept = old.join(paths.select(F.col("path").alias("rel_path")), "rel_path", "left_anti").select(*old.columns)
        self._rewrite(kept, points)

    def delete_folder(self, folder: str) -> None:
        for name in children(self.spark, self.path):
            if name.startswith("folder=") and self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[7:]) == folder:
                remove(self.spark, f"{self.path}/{name}")

    def scroll(self, folder: str, most: int | None = 400) -> DataFrame:
        """(rel_path, chunk_index) of a folder without the vectors, in order."""
        rows = self.read().where((F.col("folder") == folder) & (F.col("rel_path") != "")).select("rel_path", "chunk_index").orderBy("rel_path", "chunk_index")
        return rows if most is None else rows.limit(most)

    def count(self) -> int:
        return self.read().count()
