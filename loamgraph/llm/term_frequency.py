"""Problem 1: how often and in how many records every distinct term occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.plans.shared import materialize

# The code points with the Unicode property White_Space.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def normal_term(surface: Column) -> Column:
    """White space runs become one space, ends trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(surface, WS + "+", " ")))


def term_frequencies(current: DataFrame, *, rare_records: int = 3, rare_occurrences: int = 5, common_share: float = 0.04) -> DataFrame:
    """(term, occurrences, n_records, example, mark) for every distinct term of the current sightings.

    An external sort: the (term, record) pairs are range partitioned on the whole pair and sorted, so a term holding
    a third of all rows is spread over many ranges. Both aggregations below then find their input in order and walk
    its runs (the string minimum makes Spark take the sort aggregate): the first closes a run per (term, record), the
    second a run per term, and only the runs' totals are shuffled to join the pieces of a term cut by a range border.

    ``mark`` is ``rare`` below ``rare_records`` records or ``rare_occurrences`` occurrences, else ``common`` above
    ``common_share`` of all records, else null. ``example`` is the least original spelling. A surface of white space
    only is the empty term. No rows give no terms.
    """
    current = materialize(current, "current")  # read three times: to sample the ranges, to count terms and records
    pairs = current.select(normal_term(F.col("surface")).alias("term"), "path", "chunk_index", "surface", "cnt")
    ordered = pairs.repartitionByRange("term", "path", "chunk_index").sortWithinPartitions("term", "path", "chunk_index")
    in_records = ordered.groupBy("term", "path", "chunk_index").agg(F.sum("cnt").alias("cnt"), F.min("surface").alias("example"))
    terms = in_records.groupBy("term").agg(F.sum("cnt").alias("occurrences"), F.count(F.lit(1)).alias("n_records"), F.min("example").alias("example"))
    total = current.select("path", "chunk_index").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    rare = (F.col("n_records") < rare_records) | (F.col("occurrences") < rare_occurrences)
    common = F.col("n_records") > F.lit(common_share) * total
    return terms.withColumn("mark", F.when(rare, "rare").when(common, "common"))


def true_mentions(entities: DataFrame, current: DataFrame) -> DataFrame:
    """(id, stored, mentions): what each entity's ``mentions`` should be; an entity without sightings has 0.

    Counts are summed before the join, so a hot entity is one row of it. Rows with a null id are left out."""
    counted = current.groupBy("entity_id").agg(F.sum("cnt").alias("n"))
    rows = entities.where("id IS NOT NULL").select("id", F.col("mentions").alias("stored"))
    return rows.join(counted, rows["id"] == counted["entity_id"], "left").select("id", "stored", F.coalesce("n", F.lit(0)).alias("mentions"))
