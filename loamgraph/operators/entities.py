"""Named entities of a chunked corpus and how they are linked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import candidates_of, normal_name, slug
from loamgraph.operators.pairs import pair_counts
from loamgraph.operators.ranking import first_rows
from loamgraph.operators.vectors import near_pairs


@dataclass(frozen=True)
class Caps:
    """Bounds of the linking; null lifts one."""

    least_mentions: int = 2
    entities: int | None = 200
    sightings: int | None = 16
    judged: int | None = 80
    similar: float = 0.82


def candidates(chunks: DataFrame) -> DataFrame:
    """(path, chunk_index, raw, n): how often each candidate name stands in each chunk."""
    found = chunks.select("path", "chunk_index", F.explode(candidates_of(F.col("content"))).alias("raw"))
    return found.groupBy("path", "chunk_index", "raw").agg(F.count(F.lit(1)).alias("n"))


def mentions(chunks: DataFrame) -> DataFrame:
    """(slug, surface, path, chunk_index, n): the accepted names by entity; the base of all that follows."""
    return accepted(candidates(chunks))


def accepted(raw: DataFrame) -> DataFrame:
    """The same of candidates (path, chunk_index, raw, n) found elsewhere; refused names are left out."""
    named = raw.select("path", "chunk_index", "n", normal_name(F.col("raw")).alias("surface")).where("surface IS NOT NULL")
    keyed = named.withColumn("slug", slug(F.col("surface"))).where("length(slug) >= 2")
    return keyed.groupBy("slug", "surface", "path", "chunk_index").agg(F.sum("n").alias("n"))


def ranked(found: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """(id, slug, mentions) of the most mentioned entities; ties by the slug."""
    counted = found.groupBy("slug").agg(F.sum("n").alias("mentions")).where(F.col("mentions") >= caps.least_mentions)
    return first_rows(counted.withColumn("id", F.concat(F.lit("entity:"), "slug")).select("id", "slug", "mentions"), [F.desc("mentions"), F.col("slug")], caps.entities)


def _of(found: DataFrame, kept: DataFrame) -> DataFrame:
    return found.join(kept.select("id", "slug"), "slug")


def surfaces(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, surface, n, rank): spellings, the most frequent first; rank 1 is the name, the others are aliases."""
    counted = _of(found, kept).groupBy("id", "surface").agg(F.sum("n").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "surface")))


def names(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, name, aliases, merges): merges has one note with all spellings where there are several."""
    ordered = surfaces(found, kept).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "surface"))).alias("s"))
    all_ = F.transform("s", lambda x: x["surface"])
    note = F.struct(F.lit("normalize").alias("reason"), all_.alias("surfaces"))
    rest = F.slice(all_, 2, F.greatest(F.size("s"), F.lit(1)))
    return ordered.select("id", all_[0].alias("name"), rest.alias("aliases"), F.when(F.size("s") > 1, F.array(note)).otherwise(F.array().cast("array<struct<reason:string,surfaces:array<string>>>")).alias("merges"))


def mention_edges(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(src, dst, rel, weight): entity to file, weighted by how often the file names it."""
    return _of(found, kept).groupBy(F.col("id").alias("src"), F.col("path").alias("dst")).agg(F.sum("n").alias("weight")).select("src", "dst", F.lit("mentions").alias("rel"), "weight")


def sightings(found: DataFrame, kept: DataFrame, most: int | None = 16) -> DataFrame:
    """(id, path, chunk_index, surface, n, rank): the strongest sightings of each entity; ties by path, index, surface."""
    rows = _of(found, kept).select("id", "path", "chunk_index", "surface", "n")
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "path", "chunk_index", "surface")))
    return placed if most is None else placed.where(F.col("rank") <= most)


def related_edges(found: DataFrame, kept: DataFrame) -> DataFrame:
    """(src, dst, rel, weight): pairs of entities by the number of chunks that name both; src < dst."""
    there = _of(found, kept).select("id", "path", "chunk_index").distinct()
    pairs = pair_counts(there, ["path", "chunk_index"], "id")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("relates_to").alias("rel"), F.col("n").alias("weight"))


def conflict_edges(vectors: DataFrame, ranked_ids: DataFrame, caps: Caps = Caps(), *, key: str = "id", vector: str = "vector") -> DataFrame:
    """(src, dst, rel, weight): the most mentioned entities whose name vectors are near, weight 100 times the cosine."""
    judged = first_rows(ranked_ids, [F.desc("mentions"), F.col("id")], caps.judged).select(F.col("id").alias(key))
    chosen = vectors.join(judged, key, "left_semi")
    pairs = near_pairs(chosen, chosen, caps.similar, key=key, vector=vector)
    weight = F.least(F.greatest(F.round(F.col("score") * 100), F.lit(0.0)), F.lit(100.0)).cast("bigint")
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("conflicts_with").alias("rel"), weight.alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at a node other than mentions; a loop counts once."""
    ends = edges.where("rel <> 'mentions' OR rel IS NULL").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@dataclass(frozen=True)
class Linked:
    """All that linking a corpus gives; every field is lazy."""

    entities: DataFrame
    edges: DataFrame
    stats: DataFrame


def link(chunks: DataFrame, caps: Caps = Caps(), found: DataFrame | None = None) -> Linked:
    """Link a corpus: entities with names, files and sightings, mention and relation edges, and counts.

    ``found`` may hold ``mentions(chunks)`` written before, since every result is derived from it.
    """
    found = mentions(chunks) if found is None else found
    kept = ranked(found, caps)
    mention, related = mention_edges(found, kept), related_edges(found, kept)
    item = F.struct(F.col("rank"), F.col("path"), F.col("chunk_index"), F.col("surface"), F.col("n"))
    seen = sightings(found, kept, caps.sightings).groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    strip = F.transform("s", lambda x: F.struct(x["path"].alias("path"), x["chunk_index"].alias("chunk_index"), x["surface"].alias("surface"), x["n"].alias("count")))
    files = mention.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("dst")))).alias("f"))
    entities = (
        kept.join(names(found, kept), "id")
        .join(files.select("id", F.transform("f", lambda x: x["dst"]).alias("files")), "id")
        .join(seen.select("id", strip.alias("sightings")), "id")
        .select("id", "name", F.lit("concept").alias("kind"), "aliases", "files", "mentions", "sightings", "merges", F.array().cast("array<string>").alias("flags"), F.lit(False).alias("withheld"))
    )
    return Linked(entities, mention.unionByName(related), statistics(entities, mention.unionByName(related), candidates(chunks)))


def statistics(entities: DataFrame, edges: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: candidates, entities, visible, withheld, cross_file, merges, mentions, relates_to, conflicts."""
    e = entities.agg(F.count(F.lit(1)).alias("entities"), F.count_if(~F.col("withheld")).alias("visible"), F.count_if("withheld").alias("withheld"), F.count_if(F.size("files") > 1).alias("cross_file"), F.count_if(F.size("merges") > 0).alias("merges"))
    of = lambda rel: F.count_if(F.col("rel") == rel).alias(rel)
    counted = edges.agg(of("mentions"), of("relates_to"), of("conflicts_with")).withColumnRenamed("conflicts_with", "conflicts")
    total = raw.agg(F.count(F.lit(1)).alias("n"))
    return e.withColumns({"candidates": total.scalar(), **{c: counted.select(c).scalar() for c in counted.columns}})
