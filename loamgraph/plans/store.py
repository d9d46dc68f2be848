"""Tables by folder that change all at once."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.plans.shared import children, remove


class Store:
    """Tables under ``home``, each in one part a folder taken in, listed by numbered manifests.

    New parts are written beside the old ones and count once the manifest that names them is complete, all together; a
    failure before leaves the old state. Parts that neither the new nor the last manifest names are then deleted, so
    a query that is under way keeps what it reads until the next change but one.
    """

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def _manifest(self) -> tuple[int, dict[tuple[str, str], str]]:
        whole = [n for n in children(self.spark, f"{self.home}/manifests") if "_SUCCESS" in children(self.spark, f"{self.home}/manifests/{n}")]
        if not whole:
            return 0, {}
        rows = self.spark.read.parquet(f"{self.home}/manifests/{whole[-1]}").collect()  # one row a table and folder
        return int(whole[-1]), {(r["folder"], r["name"]): r["part"] for r in rows}

    def folders(self) -> list[str]:
        return sorted({folder for folder, _ in self._manifest()[1]})

    def tables(self) -> set[str]:
        return {name for _, name in self._manifest()[1]}

    def read(self, name: str, folder: str | None = None) -> DataFrame:
        """A table of one folder, or of all with the column ``folder``."""
        parts = {f: part for (f, n), part in self._manifest()[1].items() if n == name and folder in (None, f)}
        if not parts:
            raise ValueError(f"no table {name}" + (f" of folder {folder}" if folder else ""))
        one = lambda part: self.spark.read.parquet(f"{self.home}/parts/{part}")
        if folder is not None:
            return one(parts[folder])
        return functools.reduce(DataFrame.unionByName, (one(part).withColumn("folder", F.lit(f)) for f, part in sorted(parts.items())))

    def put(self, folder: str, tables: Mapping[str, DataFrame]) -> None:
        """Replace tables of a folder, all at once."""
        number, before = self._manifest()
        written = {}
        for name, rows in tables.items():
            written[folder, name] = part = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.home}/parts/{part}")
        self._switch(number, before, {**before, **written})

    def drop(self, folder: str) -> None:
        number, before = self._manifest()
        self._switch(number, before, {k: part for k, part in before.items() if k[0] != folder})

    def _switch(self, number: int, before: dict[tuple[str, str], str], after: dict[tuple[str, str], str]) -> None:
        rows = [(folder, name, part) for (folder, name), part in sorted(after.items())]
        self.spark.createDataFrame(rows, "folder string, name string, part string").coalesce(1).write.parquet(f"{self.home}/manifests/{number + 1:08d}")
        needed = {*before.values(), *after.values()}
        for part in children(self.spark, f"{self.home}/parts"):
            if part not in needed:
                remove(self.spark, f"{self.home}/parts/{part}")
        for name in children(self.spark, f"{self.home}/manifests"):
            if int(name) < number:
                remove(self.spark, f"{self.home}/manifests/{name}")
