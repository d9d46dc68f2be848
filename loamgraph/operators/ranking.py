"""Positions in a total order without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.plans.shared import materialize


def with_position(rows: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows from 0 in ascending ``order``.

    The rows are range partitioned and numbered inside their range; a range's start is the number of rows before it, a
    table of one row a partition. ``order`` must be total for the numbers to be the same each time.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    kept = materialize(ranged, "ranged")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return kept.join(F.broadcast(before), "_part").withColumn(name, (inside + F.col("_before")).cast("bigint")).drop("_part", "_before")


def first_rows(rows: DataFrame, order: Sequence[Column], most: int | None) -> DataFrame:
    """The first ``most`` rows in ``order``, all of them for null."""
    return rows if most is None else rows.orderBy(*order).limit(most)
