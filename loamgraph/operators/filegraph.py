"""The graph of files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.text import INGESTED, KINDS, NO_IMPORTS, RESOLVED_ENDINGS, ending_of, folder_of, kind_of, link_specs, module_specs, quoted_specs, strip_html, walked
from loamgraph.operators.ranking import first_rows, with_position

EDGE = ("src", "dst", "rel", "weight")


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``ending`` and ``kind`` (null if unknown) to files, leaving out those a walk does not reach."""
    reached = files.where(walked(F.col(path)))
    return reached.withColumn("ending", ending_of(F.col(path))).withColumn("kind", kind_of(F.col("ending")))


def census(files: DataFrame, path: str = "path", samples: int = 12, most: int | None = None) -> DataFrame:
    """One row: the number of files of each kind, the skipped ones, the first recognised paths, and ``truncated``.

    ``most`` null counts all files; else only the first in path order are, and ``truncated`` tells that there are more."""
    walked_ = classify(files, path)
    kinds = first_rows(walked_, [F.col(path)], most)
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    first = first_rows(kinds.where("kind IS NOT NULL").select(path), [F.col(path)], samples).agg(F.array_sort(F.collect_list(path)).alias("s"))
    return kinds.agg(*counts, F.count_if(F.col("kind").isNull()).alias("skipped"), F.count(F.lit(1)).alias("_n")).withColumn("samples", first.scalar()).withColumn(
        "truncated", F.lit(False) if most is None else walked_.agg(F.count(F.lit(1)).alias("n")).scalar() > F.col("_n")
    ).drop("_n")


def is_ingested(kind):
    return kind.isin(*INGESTED)


def file_nodes(files: DataFrame, path: str = "path", most: int | None = 400) -> DataFrame:
    """(id, kind, label) of recognised files in path order; ``most`` null lifts the cap."""
    known = first_rows(classify(files, path).where("kind IS NOT NULL"), [F.col(path)], most)
    return known.select(F.col(path).alias("id"), "kind", F.element_at(F.split(path, "/"), -1).alias("label"))


def specs(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(src, spec): what the files import or link to, as written, with repeats.

    Quoted imports in any text, ``mod`` lines in Rust, links in Markdown and HTML; HTML without its tags."""
    readable = classify(files, path).where(F.col("kind").isNotNull() & ~F.col("kind").isin(*NO_IMPORTS))
    body = F.when(F.col("kind") == "html", strip_html(F.col(text))).otherwise(F.col(text))
    none = F.array().cast("array<string>")
    found = F.concat(
        quoted_specs(body),
        F.when(F.col("ending") == "rs", module_specs(body)).otherwise(none),
        F.when(F.col("ending").isin("md", "html", "htm"), link_specs(body)).otherwise(none),
    )
    return readable.select(F.col(path).alias("src"), F.explode(found).alias("spec"))


def resolve(imports: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """(src, dst, rel, weight): each import that leads to a file; the first ending that fits wins.

    Addresses, scoped and ``crate:`` names lead nowhere; ``..`` is not followed. The candidates of every import are
    joined with the files by path, and the best taken per import, so the file index is never sent around whole.
    """
    local = imports.where(~F.col("spec").rlike("^(?:https?:|mailto:|crate:|@)"))
    bare = F.regexp_replace("spec", r"^(?:\./)+", "")
    trimmed = local.withColumn("_bare", bare).where((F.col("_bare") != "") & ~F.col("_bare").startswith("node_modules/"))
    folder = folder_of(F.col("src"))
    # a rooted spec replaces the folder, as joining paths does
    start = F.when(F.col("_bare").startswith("/"), F.col("_bare")).when(folder == "", F.col("_bare")).otherwise(F.concat(folder, F.lit("/"), "_bare"))
    endings = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(e).alias("e")) for i, e in enumerate(RESOLVED_ENDINGS)))
    tried = trimmed.withColumn("_n", F.monotonically_increasing_id()).withColumn("_start", start).select("src", "spec", "_n", "_start", F.explode(endings).alias("_try"))
    candidates = tried.select("src", "_n", F.col("_try.at").alias("_at"), F.concat("_start", "_try.e").alias("dst"))
    hits = candidates.join(files.select(F.col(path).alias("dst")).distinct(), "dst")
    best = hits.groupBy("_n", "src").agg(F.min_by("dst", "_at").alias("dst"))
    return best.where("src <> dst").select("src", "dst", F.lit("imports").alias("rel"), F.lit(1).cast("bigint").alias("weight"))


def sibling_edges(nodes: DataFrame) -> DataFrame:
    """Files of a folder in a chain, closed to a ring where there are more than two.

    All files are numbered in order of folder and id by range, and each is joined with the next number, so a folder of
    any size is spread over the tasks; of a folder only its first and last file and their number are aggregated."""
    placed = with_position(nodes.select("id", folder_of(F.col("id")).alias("folder")).distinct(), ["folder", "id"])
    following = placed.select((F.col("position") - 1).alias("position"), F.col("folder").alias("_folder"), F.col("id").alias("dst"))
    chain = placed.join(following, "position").where("folder = _folder").select(F.col("id").alias("src"), "dst")
    ends = placed.groupBy("folder").agg(F.max("id").alias("src"), F.min("id").alias("dst"), F.count(F.lit(1)).alias("n"))
    return chain.unionByName(ends.where("n > 2").select("src", "dst")).select("src", "dst", F.lit("sibling").alias("rel"), F.lit(1).cast("bigint").alias("weight"))


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """(id, kind, label) of chunks: ``path#i`` and ``stem#i``."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return chunks.select("path", "chunk_index").distinct().select(F.concat_ws("#", "path", "chunk_index").alias("id"), F.lit("chunk").alias("kind"), F.concat_ws("#", stem, "chunk_index").alias("label"))


def contains_edges(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """File to chunk, where the file has a node."""
    here = chunks.select("path", "chunk_index").distinct().join(nodes.select(F.col("id").alias("path")).distinct(), "path", "left_semi")
    return here.select(F.col("path").alias("src"), F.concat_ws("#", "path", "chunk_index").alias("dst"), F.lit("contains").alias("rel"), F.lit(1).cast("bigint").alias("weight"))


def next_edges(chunks: DataFrame) -> DataFrame:
    """Each chunk to the next one there is of the file; gaps are bridged."""
    after = F.lead("chunk_index").over(Window.partitionBy("path").orderBy("chunk_index"))
    rows = chunks.select("path", "chunk_index").distinct().withColumn("after", after).where("after IS NOT NULL")
    return rows.select(F.concat_ws("#", "path", "chunk_index").alias("src"), F.concat_ws("#", "path", "after").alias("dst"), F.lit("next").alias("rel"), F.lit(1).cast("bigint").alias("weight"))


def capped_chunks(chunks: DataFrame, per_file: int | None = 80, per_folder: int | None = 400) -> DataFrame:
    """The first chunks of each file, then of the whole folder, in path order."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("chunk_index"))
    rows = chunks if per_file is None else chunks.withColumn("_place", place).where(F.col("_place") <= per_file).drop("_place")
    return first_rows(rows, [F.col("path"), F.col("chunk_index")], per_folder)


def graft_chunks(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with the chunks' nodes and edges; nodes that are there already stay."""
    new = chunk_nodes(chunks).join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(new), edges.unionByName(contains_edges(chunks, nodes)).unionByName(next_edges(chunks))


def graft_entities(nodes: DataFrame, edges: DataFrame, entities: DataFrame, entity_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with the visible entities; edges at a withheld one are left out."""
    new = entities.where("NOT withheld").select("id", "kind", F.col("name").alias("label")).join(nodes.select("id"), "id", "left_anti")
    hidden = entities.where("withheld").select("id")
    shown = entity_edges.join(hidden.withColumnRenamed("id", "src"), "src", "left_anti").join(hidden.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*EDGE)
    return nodes.unionByName(new), edges.unionByName(shown)
