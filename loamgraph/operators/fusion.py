"""Graph expansion, reciprocal rank fusion and the hybrid retrieval made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import preview
from loamgraph.operators import lexical, vectors

K = 60.0
#: Every list is at least so long before it is fused.
LEAST_LIST = 8
SEEDS = 8


def ranked_list(hits: DataFrame, name: str, number: int) -> DataFrame:
    """(path, chunk_index, score, preview, list, number, rank) of a hit list, best first."""
    order = Window.orderBy(F.desc("score"), "path", "chunk_index")  # at most a few dozen hits
    return hits.select("path", "chunk_index", F.col("score").cast("double").alias("score"), "preview", F.lit(name).alias("list"), F.lit(number).alias("number"), F.row_number().over(order).alias("rank"))


def fuse(lists: DataFrame, limit: int, k: float = K) -> DataFrame:
    """(path, chunk_index, score, rrf_score, lists, preview) by the sum of 1 / (k + rank); ties by path and index.

    The raw score and preview are those of the first list that has the hit; ``lists`` names all that have it, in order."""
    grouped = lists.groupBy("path", "chunk_index").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.min_by("score", "number").alias("score"), F.min_by("preview", "number").alias("preview"), F.array_sort(F.collect_set(F.struct("number", "list"))).alias("_in")
    )
    best = grouped.select("path", "chunk_index", "score", "rrf_score", F.transform("_in", lambda x: x["list"]).alias("lists"), "preview")
    return best.orderBy(F.desc("rrf_score"), "path", "chunk_index").limit(limit)


def expand(hits: DataFrame, entities: DataFrame, edges: DataFrame, chunks: DataFrame, occupied: DataFrame, limit: int) -> DataFrame:
    """(path, chunk_index, score, preview): chunks reached from the hits over relations of entities.

    The eight most mentioned visible entities in the hit files are the seeds; the other end of each of their relations
    leads to its files, which are no hit files; their chunks come by weight, without those in ``occupied``. A file
    reached several times counts with its largest weight.
    """
    hit_files = hits.select("path").distinct()
    files = entities.select("id", "mentions", "withheld", F.explode(F.array_distinct("files")).alias("path"))
    seeds = files.where("NOT withheld").join(F.broadcast(hit_files), "path", "left_semi").select("id", "mentions").distinct().orderBy(F.desc("mentions"), "id").limit(SEEDS).select("id")
    related = edges.where("rel = 'relates_to'").select("src", "dst", "weight")
    both = related.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight").unionByName(related.select(F.col("dst").alias("id"), F.col("src").alias("other"), "weight"))
    others = both.join(F.broadcast(seeds), "id", "left_semi").groupBy("other").agg(F.max("weight").alias("weight"))
    reached = files.select(F.col("id").alias("other"), "path").join(others, "other").join(F.broadcast(hit_files), "path", "left_anti").groupBy("path").agg(F.max("weight").alias("score"))
    found = chunks.select("path", "chunk_index").join(reached, "path").join(F.broadcast(occupied.select("path", "chunk_index")), ["path", "chunk_index"], "left_anti")
    best = kept_list(found.select("path", "chunk_index", F.col("score").cast("double").alias("score")).orderBy(F.desc("score"), "path", "chunk_index").limit(limit))
    # only the paths of the few best are read for their content
    shown = chunks.where(F.col("path").isin([r["path"] for r in best.select("path").collect()])).select("path", "chunk_index", preview(F.col("content")).alias("preview"))
    return best.join(shown, ["path", "chunk_index"]).orderBy(F.desc("score"), "path", "chunk_index")


@dataclass(frozen=True)
class Retrieved:
    """The fused hits with their lists, one row of counts, and the files only the graph led to."""

    hits: DataFrame
    summary: DataFrame
    graph_only_files: DataFrame


def kept_list(hits: DataFrame) -> DataFrame:
    """A hit list of a few dozen rows, computed once."""
    return hits.sparkSession.createDataFrame(hits.collect(), hits.schema)


def vector_hits(points: DataFrame, query: list[float], k: int, dims: int | None = None) -> DataFrame:
    """(path, chunk_index, score, preview) of the nearest points (id, vector, rel_path, chunk_index, content)."""
    near = kept_list(vectors.top_k(points.where("rel_path <> ''"), query, k, key=["rel_path", "chunk_index", "id"], vector="vector", dims=dims))
    ids = [r["id"] for r in near.select("id").collect()]  # at most k, pushed down to the second scan
    shown = points.where(F.col("id").isin(ids)).select("id", preview(F.col("content")).alias("preview")).dropDuplicates(["id"])
    return near.join(shown, "id").select(F.col("rel_path").alias("path"), "chunk_index", "score", "preview")


def retrieve(chunks: DataFrame, points: DataFrame, entities: DataFrame, edges: DataFrame, query: str, vector: list[float], limit: int = 10, *, index: lexical.LexicalIndex | None = None, dims: int | None = None) -> Retrieved:
    """Nearest vectors, BM25 and the graph expansion from the former, fused by rank.

    Each list is computed once. ``index`` is that of the chunks, made for this query where none is given."""
    width = max(limit, LEAST_LIST)
    near = kept_list(vector_hits(points, vector, width, dims))
    words = index.search(query, width) if index else lexical.bm25(chunks, query, width)
    words = kept_list(words)
    occupied = near.select("path", "chunk_index").unionByName(words.select("path", "chunk_index")).distinct()
    graph = kept_list(expand(near, entities, edges, chunks, occupied, width))
    lists = ranked_list(near, "vector", 0).unionByName(ranked_list(words, "lexical", 1)).unionByName(ranked_list(graph, "graph", 2))
    hits = fuse(lists, limit)
    has = lambda name: F.count_if(F.array_contains("lists", name))
    summary = hits.agg(has("vector").alias("via_vector"), has("lexical").alias("via_lexical"), has("graph").alias("via_graph"))
    only = hits.where(F.col("lists") == F.array(F.lit("graph"))).select("path").distinct()
    return Retrieved(hits, summary, only)
