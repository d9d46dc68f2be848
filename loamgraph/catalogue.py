"""The queries of the engine's own operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.catalogue_sql import BM25_QUERY, FOCUS, REPEATED_QUERY, RETRIEVE_QUERY, SQL, WALK
from loamgraph.functions.chunking import chunk_documents as cut_documents
from loamgraph.functions.text import normal_name, point_id, slug, strip_html, walked, weight_label, with_slashes
from loamgraph.operators import detail, entities, filegraph, fusion, graph, layout, lexical, vectors
from loamgraph.operators.ranking import with_position
from loamgraph.plans.session import load
from loamgraph.plans.shared import children, materialize, new_folder
from loamgraph.sources.points import SCHEMA, Collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# inputs


_MADE: dict[tuple[str, str, str], tuple[str, object]] = {}


def once(spark: SparkSession, sf: str, name: str, make: Callable[[str], object]):
    """What several queries of an application need is written for the first of them: the corpus, its index, the points."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MADE or not children(spark, _MADE[key][0]):
        path = new_folder(spark, name)
        _MADE[key] = path, make(path)
    return _MADE[key][1]


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """(path, chunk_index, content): every chunk once, with ``/`` in its path."""
    rows = load(spark, sf, "chunks").where("path IS NOT NULL AND chunk_index IS NOT NULL AND content IS NOT NULL AND content <> ''")
    return rows.groupBy(with_slashes(F.col("path")).alias("path"), "chunk_index").agg(F.max("content").alias("content"))


def kept_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "corpus", lambda path: materialize(corpus(spark, sf), "corpus", path))


def index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    return once(spark, sf, "index", lambda path: lexical.LexicalIndex.build(kept_corpus(spark, sf), path))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text) of the documents as Markdown files."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return load(spark, sf, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """(path) of the files among the nodes."""
    return load(spark, sf, "nodes").where(r"id NOT LIKE 'entity:%' AND NOT id RLIKE '#[0-9]+$'").select(F.col("id").alias("path"))


def stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "entity_edges").select("src", "dst", "rel", F.coalesce("weight", F.lit(1)).alias("weight"))


def stored_entities(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "entities").select("id", "name", F.coalesce("mentions", F.lit(0)).alias("mentions"), "files", "sightings", F.coalesce("withheld", F.lit(False)).alias("withheld"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "nodes").select("id", "kind", "label")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of all chunks; the vectors are taken in order, again from the first after the last."""

    def make(path: str) -> DataFrame:
        vectors_ = load(spark, sf, "embeddings")
        placed = with_position(kept_corpus(spark, sf), ["path", "chunk_index"])
        joined = placed.withColumn("vec_id", F.col("position") % max(1, vectors_.count())).join(vectors_.select("vec_id", F.col("embedding").alias("vector")), "vec_id")
        return materialize(joined.select(F.concat_ws("#", "path", "chunk_index").alias("id"), "vector", F.col("path").alias("rel_path"), "chunk_index", "content"), "points", path)

    return once(spark, sf, "points", make)


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(load(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) + 0.0 for n in names})


# files and chunks


@query
def census_by_kind(spark, sf):
    return filegraph.census(paths(spark, sf)).drop("samples", "truncated")


@query
def census_truncated(spark, sf):
    return filegraph.census(paths(spark, sf), most=100).select("truncated", "skipped")


@query
def files_ingestable(spark, sf):
    return filegraph.classify(paths(spark, sf)).where(filegraph.is_ingested(F.col("kind"))).select("path")


@query
def census_samples(spark, sf):
    return filegraph.census(paths(spark, sf)).select(F.explode("samples").alias("path"))


@query
def files_classified(spark, sf):
    return filegraph.classify(paths(spark, sf)).select("path", "ending", "kind")


@query
def files_walk_filtered(spark, sf):
    # the tables have no skipped folder, so three quarters of the paths are put into one
    n = F.length("path") % 4
    inside = F.concat(F.when(n == 0, "node_modules/").when(n == 1, ".cache/").when(n == 2, "page_files/").otherwise(""), "path")
    return paths(spark, sf).select(inside.alias("path")).where(~walked(F.col("path")))


@query
def file_nodes_capped(spark, sf):
    return filegraph.file_nodes(paths(spark, sf))


@query
def strip_html_documents(spark, sf):
    return load(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", strip_html(F.col("text")).alias("body"))


@query
def chunk_documents(spark, sf):
    return cut_documents(load(spark, sf, "documents"), "doc_id")


@query
def chunk_caps(spark, sf):
    return filegraph.capped_chunks(corpus(spark, sf).select("path", "chunk_index"))


@query
def chunk_nodes(spark, sf):
    return filegraph.chunk_nodes(corpus(spark, sf))


@query
def chunk_contains_edges(spark, sf):
    return filegraph.contains_edges(corpus(spark, sf), filegraph.file_nodes(paths(spark, sf), most=None))


@query
def chunk_next_edges(spark, sf):
    return filegraph.next_edges(corpus(spark, sf))


@query
def sibling_edges(spark, sf):
    return filegraph.sibling_edges(filegraph.file_nodes(paths(spark, sf), most=None))


@query
def md_link_specs(spark, sf):
    return filegraph.specs(texts(spark, sf)).groupBy("src", "spec").agg(F.count(F.lit(1)).alias("n"))


@query
def code_import_specs(spark, sf):
    files = corpus(spark, sf).withColumnRenamed("content", "text")
    return filegraph.specs(files).groupBy("src", "spec").agg(F.count(F.lit(1)).alias("n"))


@query
def import_resolve(spark, sf):
    # the documents name no file of theirs, so each is given an import and a link to its successors
    n = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nimport x from './"), (n + 1).cast("string"), F.lit("'\n[a](./"), (n + 2).cast("string"), F.lit(".md)"))
    files = load(spark, sf, "documents").select(F.concat(F.lit("docs/"), n.cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    found = filegraph.resolve(filegraph.specs(files), files)
    return found.groupBy("src", "dst", "rel").agg(F.sum("weight").alias("weight"))


@query
def graft_chunks(spark, sf):
    known = nodes(spark, sf)
    grown, edges = filegraph.graft_chunks(known, spark.createDataFrame([], "src string, dst string, rel string, weight bigint"), corpus(spark, sf))
    return grown.select("id").withColumn("what", F.lit("node")).unionByName(edges.select(F.concat_ws(" ", "src", "rel", "dst").alias("id"), F.lit("edge").alias("what")))


@query
def graft_entities(spark, sf):
    ents = load(spark, sf, "entities").select("id", "kind", "name", F.coalesce("withheld", F.lit(False)).alias("withheld"))
    none = nodes(spark, sf).where("kind IN ('markdown', 'text')")
    grown, edges = filegraph.graft_entities(none, spark.createDataFrame([], "src string, dst string, rel string, weight bigint"), ents, stored_edges(spark, sf))
    return grown.select("id", F.lit("node").alias("what")).unionByName(edges.select(F.concat_ws(" ", "src", F.coalesce("rel", F.lit("?")), "dst").alias("id"), F.lit("edge").alias("what")))


@query
def point_ids(spark, sf):
    return corpus(spark, sf).select("path", "chunk_index", point_id(F.concat(F.lit("lab:"), F.concat_ws("#", "path", "chunk_index"))).alias("id"))


# entities


WHOLE = entities.Caps(entities=None)


def _found(spark, sf):
    return once(spark, sf, "mentions", lambda path: materialize(entities.mentions(corpus(spark, sf)), "mentions", path))


@query
def entity_candidates(spark, sf):
    return entities.candidates(corpus(spark, sf))


@query
def entity_normalize(spark, sf):
    raw = entities.candidates(corpus(spark, sf)).select("raw").distinct()
    return raw.select("raw", normal_name(F.col("raw")).alias("name"), slug(F.col("raw")).alias("slug"))


@query
def entity_mentions(spark, sf):
    return entities.mentions(corpus(spark, sf))


@query
def entity_top200(spark, sf):
    return entities.ranked(entities.mentions(corpus(spark, sf)))


@query
def entity_names_aliases(spark, sf):
    found = _found(spark, sf)
    return entities.surfaces(found, entities.ranked(found, WHOLE)).select("id", "surface", "n", F.col("rank").cast("bigint").alias("rank"))


@query
def entity_merge_notes(spark, sf):
    # from the sightings, whose names are spelled in several ways
    raw = load(spark, sf, "sightings").where("path IS NOT NULL AND chunk_index IS NOT NULL AND cnt IS NOT NULL").select("path", "chunk_index", F.col("cnt").alias("n"), F.col("surface").alias("raw"))
    found = materialize(entities.accepted(raw), "mentions")
    named = entities.names(found, entities.ranked(found, entities.Caps(1, None))).where(F.size("merges") > 0)
    return named.select("id", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.col("merges")[0]["surfaces"], "|").alias("surfaces"))


@query
def entity_files_mentions(spark, sf):
    found = _found(spark, sf)
    return entities.mention_edges(found, entities.ranked(found, WHOLE))


@query
def entity_sightings_top16(spark, sf):
    found = _found(spark, sf)
    return entities.sightings(found, entities.ranked(found, WHOLE)).withColumn("rank", F.col("rank").cast("bigint"))


@query
def entity_relates_to(spark, sf):
    found = _found(spark, sf)
    return entities.related_edges(found, entities.ranked(found, WHOLE))


@query
def entity_stats(spark, sf):
    return entities.link(corpus(spark, sf), WHOLE, _found(spark, sf)).stats


@query
def entity_degree(spark, sf):
    return entities.degrees(stored_edges(spark, sf).where("src IS NOT NULL AND dst IS NOT NULL"))


@query
def entity_betweenness(spark, sf):
    found = _found(spark, sf)
    kept = entities.ranked(found, WHOLE)
    return rounded(graph.betweenness(kept.select("id"), entities.related_edges(found, kept)), "betweenness")


@query
def entity_betweenness_top200(spark, sf):
    # as an engine with its usual bounds has it
    found = _found(spark, sf)
    kept = entities.ranked(found)
    return rounded(graph.betweenness(kept.select("id"), entities.related_edges(found, kept)), "betweenness")


@query
def conflicts_with(spark, sf):
    rows = load(spark, sf, "embeddings").select(F.concat(F.lit("vec:"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"), ((F.col("vec_id") * 7919) % 1000).alias("mentions"))
    return entities.conflict_edges(rows.select("id", "vector"), rows.select("id", "mentions"), entities.Caps(similar=0.2))


# vectors


@query
def vector_topk(spark, sf):
    return rounded(vectors.top_k(load(spark, sf, "embeddings"), first_vector(spark, sf), 10), "score")


@query
def vector_topk_filtered(spark, sf):
    return rounded(vectors.top_k(load(spark, sf, "embeddings").where("label = 3"), first_vector(spark, sf), 10), "score")


@query
def vector_nearest(spark, sf):
    rows = load(spark, sf, "embeddings")
    return rounded(vectors.nearest(rows.where("vec_id % 20 = 0"), rows, 5), "score").withColumn("rank", F.col("rank").cast("bigint"))


@query
def near_pairs(spark, sf):
    rows = load(spark, sf, "embeddings")
    return rounded(vectors.near_pairs(rows.where("vec_id % 20 = 0"), rows, 0.3), "score")


# retrieval


@query
def tokenize_documents(spark, sf):
    docs = load(spark, sf, "documents").select(F.lit("d").alias("path"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return lexical.term_statistics(docs)


@query
def bm25_postings(spark, sf):
    found = lexical.postings(corpus(spark, sf))
    return found.select("path", "chunk_index", "term", "tf", F.col("dl").cast("bigint").alias("dl"))


@query
def bm25_topk(spark, sf):
    return rounded(index(spark, sf).search(BM25_QUERY, 20), "score")


@query
def bm25_repeated_term(spark, sf):
    return rounded(index(spark, sf).search(REPEATED_QUERY, 20), "score")


@query
def graph_expand(spark, sf):
    hits = fusion.kept_list(fusion.vector_hits(points(spark, sf), first_vector(spark, sf), 8))
    return fusion.expand(hits, stored_entities(spark, sf), stored_edges(spark, sf), kept_corpus(spark, sf), hits, 12)


def _fused_lists(spark, sf):
    lists = (fusion.ranked_list(fusion.kept_list(index(spark, sf).search(q, 20)), name, i) for i, (q, name) in enumerate(((BM25_QUERY, "a"), (REPEATED_QUERY, "b"))))
    return fusion.fuse(next(lists).unionByName(next(lists)), 15)


@query
def rrf_fuse(spark, sf):
    return rounded(_fused_lists(spark, sf), "score", "rrf_score", places=6).withColumn("lists", F.array_join("lists", "+"))


def _retrieved(spark, sf):
    return fusion.retrieve(kept_corpus(spark, sf), points(spark, sf), stored_entities(spark, sf), stored_edges(spark, sf), RETRIEVE_QUERY, first_vector(spark, sf), 12, index=index(spark, sf), dims=64)


@query
def retrieve_hybrid(spark, sf):
    return rounded(_retrieved(spark, sf).hits, "score", "rrf_score").withColumn("lists", F.array_join("lists", "+"))


@query
def retrieve_provenance(spark, sf):
    return _retrieved(spark, sf).summary


@query
def retrieve_graph_only_files(spark, sf):
    return _retrieved(spark, sf).graph_only_files


# walks and cards


@query
def hop(spark, sf):
    return graph.hop(stored_edges(spark, sf), FOCUS)


@query
def blast_depth1(spark, sf):
    return graph.blast(stored_edges(spark, sf), WALK, 1)


@query
def blast_depth2(spark, sf):
    return graph.blast(stored_edges(spark, sf), WALK, 2)


@query
def blast_depth3(spark, sf):
    return graph.blast(stored_edges(spark, sf), WALK, 3)


@query
def node_card_neighbors(spark, sf):
    return detail.neighbours(stored_edges(spark, sf), nodes(spark, sf), stored_entities(spark, sf), FOCUS)


@query
def node_card_strongest(spark, sf):
    found = detail.strongest_neighbours(stored_edges(spark, sf), nodes(spark, sf), stored_entities(spark, sf), FOCUS)
    return found.select("rel", "weight", "id", weight_label(F.col("rel"), F.col("weight")).alias("shown"))


@query
def node_card_passages(spark, sf):
    return detail.entity_passages(stored_entities(spark, sf), corpus(spark, sf), FOCUS)


@query
def node_card_file(spark, sf):
    first = corpus(spark, sf).agg(F.min("path")).first()[0]
    return detail.node_passages(corpus(spark, sf), first)


@query
def entity_detail_chunks(spark, sf):
    return detail.entity_chunks(stored_entities(spark, sf), corpus(spark, sf), FOCUS)


@query
def node_labels(spark, sf):
    return graph.labels(graph.hop(stored_edges(spark, sf), FOCUS), nodes(spark, sf), stored_entities(spark, sf)).select("id", "label")


@query
def node_degrees(spark, sf):
    return detail.degree(stored_edges(spark, sf), FOCUS)


@query
def card_first_passages(spark, sf):
    return detail.first_passages(detail.entity_passages(stored_entities(spark, sf), kept_corpus(spark, sf), FOCUS))


@query
def card_first_files(spark, sf):
    return detail.first_files(stored_entities(spark, sf), FOCUS)


@query
def card_hit_scores(spark, sf):
    scored = detail.with_scores(kept_corpus(spark, sf).select("path", "chunk_index"), _fused_lists(spark, sf))
    return rounded(scored, "score", "rrf_score").withColumn("lists", F.array_join("lists", "+"))


# collection


def _collection(spark, sf):
    rows = points(spark, sf).withColumn("folder", F.split_part("rel_path", F.lit("/"), F.lit(1))).withColumn("abs_path", F.concat(F.lit("/lab/"), "rel_path")).withColumn("source", F.lit("ingest"))
    rows = rows.select([f.split()[0] for f in SCHEMA.split(", ")])
    kept = Collection(spark, new_folder(spark, "collection"), 64).ensure()
    kept.replace_folder(rows)
    return kept, rows


@query
def points_scroll(spark, sf):
    kept, rows = _collection(spark, sf)
    return kept.scroll(rows.agg(F.min("folder")).first()[0], None)


@query
def points_count(spark, sf):
    return _collection(spark, sf)[0].read().groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


@query
def points_delete_upsert(spark, sf):
    kept, rows = _collection(spark, sf)
    kept.delete_folder(rows.agg(F.min("folder")).first()[0])
    kept.upsert(rows.where("chunk_index = 0").withColumn("content", F.lit("changed")))
    return kept.read().select("id", "folder", "chunk_index", "content")


# places


@query
def layout_sphere(spark, sf):
    return rounded(layout.place_files(filegraph.file_nodes(paths(spark, sf), most=None)), "x", "y", "z")


@query
def layout_entity_radius(spark, sf):
    return rounded(layout.place_entities(load(spark, sf, "entities").select("id"), stored_edges(spark, sf), 4.0), "radius", "x", "y", "z")


@query
def layout_chunk_ring(spark, sf):
    files = layout.place_files(filegraph.file_nodes(paths(spark, sf), most=None))
    return rounded(layout.place_chunks(corpus(spark, sf), files, 4.0), "x", "y", "z")


@query
def membranes(spark, sf):
    return layout.membranes(stored_edges(spark, sf))


@query
def edge_tubes(spark, sf):
    kind = F.when(F.col("dst").contains("#"), "chunk").when(~F.col("dst").startswith("entity:"), "file").otherwise("entity")
    return rounded(stored_edges(spark, sf).select("src", "dst", "rel", layout.tube_radius(kind, F.col("weight")).alias("radius")), "radius")


@query
def edge_colours(spark, sf):
    return stored_edges(spark, sf).select("src", "dst", "rel", layout.edge_colour(F.col("rel")).alias("colour"))


@query
def layout_linlog(spark, sf):
    found = _found(spark, sf)
    kept = entities.ranked(found, WHOLE)
    return layout.linlog(kept.select("id"), entities.related_edges(found, kept))


__all__ = ["QUERIES", "SQL"]
