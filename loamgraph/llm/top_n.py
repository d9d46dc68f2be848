"""Problem 3: the N best rows of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, *, only_larger: bool = False) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their ``rank`` from 1.

    A row_number window under a rank filter: the optimiser's group limit keeps at most the wanted rows of a group in
    every task before the shuffle and again after it, so no task sees a whole hot group. With ``only_larger`` groups of
    ``n`` rows or fewer give nothing; for that one more row is let through and looked at, with no second shuffle.
    ``order`` must be total over distinct rows; exactly repeated rows are interchangeable. Null groups form a group.
    """
    by_group = Window.partitionBy(*group)
    ranked = rows.withColumn("rank", F.row_number().over(by_group.orderBy(*order)))
    if not only_larger:
        return ranked.where(F.col("rank") <= n)
    kept = ranked.where(F.col("rank") <= n + 1)
    return kept.withColumn("_last", F.max("rank").over(by_group)).where((F.col("_last") > n) & (F.col("rank") <= n)).drop("_last")


SIGHTING_ORDER = ("cnt", "path", "chunk_index", "surface")


def strongest_sightings(current: DataFrame, n: int = 16, *, only_larger: bool = False) -> DataFrame:
    """The ``n`` strongest current sightings of each entity: ``cnt`` descending, then path, chunk_index, surface."""
    order = [F.col("cnt").desc(), F.col("path"), F.col("chunk_index"), F.col("surface")]
    return top_n(current.select("entity_id", "path", "chunk_index", "surface", "cnt"), ["entity_id"], order, n, only_larger=only_larger)


def sightings_column(current: DataFrame, n: int = 16) -> DataFrame:
    """(entity_id, sightings): ``Entity.sightings`` rebuilt, at most ``n`` structs an entity, in rank order."""
    best = strongest_sightings(current, n)
    item = F.struct("rank", "path", "chunk_index", "surface", "cnt")
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["path"].alias("path"), s["chunk_index"].alias("chunk_index"), s["surface"].alias("surface"), s["cnt"].alias("cnt")))
    return best.groupBy("entity_id").agg(ordered.alias("sightings"))
