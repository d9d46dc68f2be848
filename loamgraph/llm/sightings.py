"""The sightings that hold now, out of a table of repeated, late and revised scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("entity_id", "path", "chunk_index", "surface")
RECORD = ("path", "chunk_index")


def current_sightings(sightings: DataFrame) -> DataFrame:
    """One row (entity_id, path, chunk_index, surface, cnt) per sighting that counts.

    Rows with a null in the key are left out. Of equal keys the row with the latest ``seen_at`` stands (null is
    earliest; ties by ``arrived_at``, then by the larger ``cnt``), and it counts if its ``cnt`` is above 0. Repeated
    rows are merged before the shuffle. An empty table gives an empty table; other columns are ignored.
    """
    whole = sightings.select(*KEY, "cnt", "seen_at", "arrived_at").where(" AND ".join(f"{c} IS NOT NULL" for c in KEY))
    newest = whole.groupBy(*KEY).agg(F.max(F.struct("seen_at", "arrived_at", "cnt")).alias("newest"))
    return newest.select(*KEY, F.col("newest.cnt").alias("cnt")).where("cnt > 0")


CURRENT_SQL = """current AS (
  SELECT entity_id, path, chunk_index, surface, cnt FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, path, chunk_index, surface
                                 ORDER BY seen_at DESC NULLS LAST, arrived_at DESC NULLS LAST, cnt DESC NULLS LAST) AS nth
    FROM sightings
    WHERE entity_id IS NOT NULL AND path IS NOT NULL AND chunk_index IS NOT NULL AND surface IS NOT NULL)
  WHERE nth = 1 AND cnt > 0)"""
