"""The graph tools as SQL table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BOTH = "(SELECT src AS a, dst AS b FROM {0} WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT dst, src FROM {0} WHERE src IS NOT NULL AND dst IS NOT NULL)"


def register_tools(spark: SparkSession, nodes: DataFrame, edges: DataFrame, prefix: str = "loam") -> None:
    """Register ``{prefix}_hop(focus)`` and ``{prefix}_blast(focus, depth)``, depth 1 to 3, with views of the tables they read.

    They give (id, label) and (id, label, distance), as the tools of the same name do; null labels are ids. Both are
    plain SQL, so Spark plans them into the query that calls them."""
    nodes.createOrReplaceTempView(f"{prefix}_nodes")
    edges.createOrReplaceTempView(f"{prefix}_edges")
    both = _BOTH.format(f"{prefix}_edges")
    labelled = f"LEFT JOIN (SELECT id, max(label) AS label FROM {prefix}_nodes GROUP BY id) n USING (id)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_hop(focus STRING) RETURNS TABLE(id STRING, label STRING) RETURN SELECT id, coalesce(label, id) FROM (SELECT DISTINCT b AS id FROM {both} WHERE a = focus) {labelled}")
    steps = [f"SELECT b AS id, 1 AS distance FROM {both} WHERE a = focus"]
    for n in (2, 3):
        steps.append(f"SELECT e.b AS id, {n} AS distance FROM (SELECT DISTINCT id FROM ({steps[-1]})) f JOIN {both} e ON e.a = f.id WHERE depth >= {n}")
    walk = " UNION ALL ".join(steps)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_blast(focus STRING, depth INT) RETURNS TABLE(id STRING, label STRING, distance INT) RETURN SELECT id, coalesce(label, id), distance FROM (SELECT id, min(distance) AS distance FROM ({walk}) WHERE id <> focus GROUP BY id) {labelled}")
