"""The queries of the problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import contamination, cooccurrence, name_variants, reading_level, sightings, source_files, term_frequency, tokenization, top_n
from loamgraph.plans.session import load
from loamgraph.plans.shared import materialize


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return sightings.current_sightings(load(spark, sf, "sightings"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return term_frequency.term_frequencies(_current(spark, sf)).where("mark IS NOT NULL").select("term", "mark")


def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_frequency.term_frequencies(_current(spark, sf)).select("term", "occurrences", "n_records", "example", "mark")


def p1_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return term_frequency.true_mentions(load(spark, sf, "entities"), _current(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.variant_pairs(load(spark, sf, "entities"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.strongest_sightings(_current(spark, sf), only_larger=True).select("entity_id", "path", "chunk_index", "surface")


def p3_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.strongest_sightings(_current(spark, sf)).select("entity_id", "rank", "path", "chunk_index", "surface", "cnt")


def p3_sightings_column(spark: SparkSession, sf: str) -> DataFrame:
    nested = top_n.sightings_column(_current(spark, sf))
    return nested.select("entity_id", F.posexplode("sightings").alias("at", "s")).select("entity_id", "at", "s.path", "s.chunk_index", "s.surface", "s.cnt")


def _pair_table(spark: SparkSession, sf: str, column: str, share: float) -> cooccurrence.PairTable:
    """The table after two batches: the rows up to the given share by ``column``, then the records that later rows name."""
    rows = load(spark, sf, "sightings")
    middle = rows.agg(F.percentile_approx(column, share)).first()[0]
    late = F.col(column).isNull() | (F.col(column) > middle)
    table = cooccurrence.PairTable(spark).apply(cooccurrence.sighting_baskets(sightings.current_sightings(rows.where(~late))))
    touched = materialize(rows.where(late & F.col("path").isNotNull() & F.col("chunk_index").isNotNull()).select("path", "chunk_index").distinct(), "touched")
    after = materialize(cooccurrence.sighting_baskets(sightings.current_sightings(rows.join(touched, ["path", "chunk_index"], "left_semi"))), "after")
    emptied = touched.join(after, ["path", "chunk_index"], "left_anti").withColumn("item", F.lit(None).cast("string"))
    return table.apply(after.unionByName(emptied))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a table that was filled with all but the last fiftieth of the arrivals and then told of the records these changed."""
    table = _pair_table(spark, sf, "arrived_at", 0.98)
    return table.associations(min_together=5, min_lift=6).select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


def p4_changes(spark: SparkSession, sf: str) -> DataFrame:
    """All pair counts, of a table made from the first half of the scans and then told of the records that later ones changed."""
    table = _pair_table(spark, sf, "seen_at", 0.5)
    return table.associations().select(F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "n", "n_a", "n_b", "total", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_reasons(spark, sf).select("path")


def p5_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return source_files.not_by_hand(load(spark, sf, "nodes"), load(spark, sf, "chunks"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenization.encode(load(spark, sf, "documents"))


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the text that its ids decode to."""
    documents = load(spark, sf, "documents").select("doc_id", "text")
    return documents.select("doc_id").join(tokenization.decode(tokenization.encode(documents)), "doc_id", "left").select("doc_id", "text")


def p6_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the characters that its tokens cover and whether they follow each other without a gap."""
    spans = tokenization.encode_with_offsets(load(spark, sf, "documents"))
    gaps = F.exists(F.zip_with(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda a, b: a > b), lambda x: x)
    return spans.select("doc_id", F.coalesce(F.array_min("starts"), F.lit(0)).alias("first"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("last"), gaps.alias("gaps"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaked_items(load(spark, sf, "documents"), load(spark, sf, "eval_items")).select("doc_id", "item_id")


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.reading_levels(load(spark, sf, "documents"), load(spark, sf, "reading_labels"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).where("demanding").select("doc_id")


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.all_reading_levels(load(spark, sf, "documents"), load(spark, sf, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_terms, p1_mentions, p2_found, p3_found, p3_ranked, p3_sightings_column, p4_found, p4_changes, p5_found, p5_reasons, p6_ids, p6_round_trip, p6_offsets, p7_found, p8_found, p8_levels)
}

_TERM = rf"lower(trim(regexp_replace(surface, '{term_frequency.WS}+', ' ', 'g')))"
_TERMS = f"""WITH {sightings.CURRENT_SQL},
pairs AS (SELECT {_TERM} AS term, path, chunk_index, surface, cnt FROM current),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT path, chunk_index FROM current)),
terms AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS occurrences, CAST(count(DISTINCT (path, chunk_index)) AS BIGINT) AS n_records,
                 min(surface) AS example FROM pairs GROUP BY term),
marked AS (SELECT terms.*, CASE WHEN n_records < 3 OR occurrences < 5 THEN 'rare' WHEN n_records > 0.04 * n THEN 'common' END AS mark FROM terms, total)"""
_RANKED = f"""WITH {sightings.CURRENT_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY cnt DESC, path, chunk_index, surface) AS nth,
                  count(*) OVER (PARTITION BY entity_id) AS held FROM current)"""
_PAIRS = f"""WITH {sightings.CURRENT_SQL},
baskets AS (SELECT DISTINCT path, chunk_index, entity_id FROM current),
total AS (SELECT CAST(count(*) AS BIGINT) AS total FROM (SELECT DISTINCT path, chunk_index FROM baskets)),
items AS (SELECT entity_id, CAST(count(*) AS BIGINT) AS n FROM baskets GROUP BY entity_id),
pairs AS (SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, CAST(count(*) AS BIGINT) AS n
          FROM baskets a JOIN baskets b ON a.path = b.path AND a.chunk_index = b.chunk_index AND a.entity_id < b.entity_id GROUP BY ALL),
scored AS (SELECT pairs.*, ia.n AS n_a, ib.n AS n_b, total FROM pairs JOIN items ia ON ia.entity_id = entity_a JOIN items ib ON ib.entity_id = entity_b, total)"""

SQL: dict[str, str] = {
    "p1_found": f"{_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": f"{_TERMS} SELECT term, occurrences, n_records, example, mark FROM marked",
    "p1_mentions": f"""WITH {sightings.CURRENT_SQL} SELECT id, e.mentions AS stored, CAST(coalesce(n, 0) AS BIGINT) AS mentions
        FROM entities e LEFT JOIN (SELECT entity_id, sum(cnt) AS n FROM current GROUP BY entity_id) ON id = entity_id WHERE id IS NOT NULL""",
    "p3_found": f"{_RANKED} SELECT entity_id, path, chunk_index, surface FROM ranked WHERE held > 16 AND nth <= 16",
    "p3_ranked": f"{_RANKED} SELECT entity_id, CAST(nth AS INTEGER) AS rank, path, chunk_index, surface, cnt FROM ranked WHERE nth <= 16",
    "p3_sightings_column": f"{_RANKED} SELECT entity_id, CAST(nth - 1 AS INTEGER) AS at, path, chunk_index, surface, cnt FROM ranked WHERE nth <= 16",
    "p4_found": f"{_PAIRS} SELECT entity_a, entity_b FROM scored WHERE n >= 5 AND n * total >= 6 * n_a * n_b",
    "p4_changes": f"{_PAIRS} SELECT entity_a, entity_b, n, n_a, n_b, total, round(n * total / (n_a * n_b), 6) AS lift FROM scored",
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_offsets": "SELECT doc_id, CAST(0 AS INTEGER) AS first, CAST(coalesce(length(text), 0) AS INTEGER) AS last, false AS gaps FROM documents",
}
