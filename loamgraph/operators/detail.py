"""The card of a node: neighbours and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import chunk_number, chunk_path, preview
from loamgraph.operators.graph import labels

EXCERPT = 280


def incident(edges: DataFrame, focus: str) -> DataFrame:
    """(rel, weight, id): the edges at a node with their other end, repeats kept."""
    other = F.when(F.col("src") == focus, F.col("dst")).otherwise(F.col("src"))
    return edges.where((F.col("src") == focus) | (F.col("dst") == focus)).select("rel", F.coalesce("weight", F.lit(1)).cast("bigint").alias("weight"), other.alias("id"))


def neighbours(edges: DataFrame, nodes: DataFrame, entities: DataFrame, focus: str) -> DataFrame:
    """(rel, weight, id, label) of the edges at a node."""
    return labels(incident(edges, focus), nodes, entities).select("rel", "weight", "id", "label")


def entity_passages(entities: DataFrame, chunks: DataFrame, focus: str) -> DataFrame:
    """(path, chunk_index, surface, excerpt) of an entity's sightings; a chunk that is gone has an empty excerpt."""
    seen = entities.where(F.col("id") == focus).select(F.explode("sightings").alias("s")).select("s.path", "s.chunk_index", "s.surface")
    bodies = chunks.select("path", "chunk_index", preview(F.col("content"), EXCERPT).alias("_body"))
    return seen.join(bodies, ["path", "chunk_index"], "left").select("path", "chunk_index", "surface", F.coalesce("_body", F.lit("")).alias("excerpt"))


def node_passages(chunks: DataFrame, focus: str, most: int = 6) -> DataFrame:
    """(path, chunk_index, surface, excerpt): the chunk of a chunk node, else the first chunks of a file.

    An id with ``#`` and no number behind it has none."""
    row = F.lit(focus)
    as_chunk = (F.col("path") == chunk_path(row)) & (F.col("chunk_index") == chunk_number(row))
    found = chunks.where(as_chunk if "#" in focus else F.col("path") == focus)
    place = F.row_number().over(Window.partitionBy("path").orderBy("chunk_index"))
    first = found.withColumn("_place", place).where(F.col("_place") <= (1 if "#" in focus else most))
    return first.select("path", "chunk_index", F.lit("").alias("surface"), preview(F.col("content"), EXCERPT).alias("excerpt"))


def entity_chunks(entities: DataFrame, chunks: DataFrame, focus: str) -> DataFrame:
    """All chunks of the files of an entity."""
    files = entities.where(F.col("id") == focus).select(F.explode("files").alias("path")).distinct()
    return chunks.join(files, "path", "left_semi")


def strongest_neighbours(edges: DataFrame, nodes: DataFrame, entities: DataFrame, focus: str, most: int = 16) -> DataFrame:
    return neighbours(edges, nodes, entities, focus).orderBy(F.desc("weight"), "id", "rel").limit(most)


def degree(edges: DataFrame, focus: str) -> DataFrame:
    """(degree): one row, the number of neighbour rows of a node, repeats counted."""
    return incident(edges, focus).agg(F.count(F.lit(1)).alias("degree"))


def first_passages(passages: DataFrame, most: int = 8) -> DataFrame:
    """The passages a card shows, in order."""
    return passages.orderBy("path", "chunk_index", "surface").limit(most)


def first_files(entities: DataFrame, focus: str, most: int = 8) -> DataFrame:
    """(path, n): the files a card names, in the order in which the entity has them, with the number of all."""
    row = entities.where(F.col("id") == focus).select(F.size("files").alias("n"), F.posexplode(F.slice("files", 1, most)).alias("at", "path"))
    return row.orderBy("at").select("path", "n")


def with_scores(passages: DataFrame, hits: DataFrame) -> DataFrame:
    """Passages with the score, fused score and lists of the hit that is the same chunk; nulls where none is."""
    scored = hits.select("path", "chunk_index", "score", "rrf_score", "lists")
    return passages.join(scored, ["path", "chunk_index"], "left")
