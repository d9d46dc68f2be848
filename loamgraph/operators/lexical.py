"""Lexical retrieval by BM25."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import preview, tokens_of
from loamgraph.plans.shared import new_folder

K1, B = 1.2, 0.75


def query_terms(query: str) -> Counter:
    """The terms of a query with how often each is asked for; repeats count."""
    return Counter(w for w in re.split("[^a-z0-9]", query.lower()) if len(w) > 2)


def postings(chunks: DataFrame) -> DataFrame:
    """(path, chunk_index, term, tf, dl): the inverted index of a corpus, for many queries."""
    tokens = chunks.select("path", "chunk_index", tokens_of(F.col("content")).alias("tokens"))
    each = tokens.select("path", "chunk_index", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return each.groupBy("path", "chunk_index", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("path", "chunk_index", "term", "tf", "dl")


def term_statistics(chunks: DataFrame) -> DataFrame:
    """(term, df, tf): in how many chunks and how often each term stands."""
    return postings(chunks).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


class LexicalIndex:
    """Postings, document frequencies and previews of a corpus, written once and read by many queries.

    Postings lie in order of their term (a frequent term over several files), so that a query reads those of its own
    terms by the files' statistics; previews lie in order of the path. A query never reads the corpus.
    """

    def __init__(self, spark: SparkSession, path: str, *, parts: Mapping[str, str] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.parts = dict(parts) if parts is not None else {"": self.path}

    @classmethod
    def of(cls, spark: SparkSession, parts: Mapping[str, str]) -> LexicalIndex:
        """Several indexes as one corpus, whose paths begin with the name of their part."""
        return cls(spark, "", parts=parts)

    @classmethod
    def build(cls, chunks: DataFrame, path: str) -> LexicalIndex:
        """Index (path, chunk_index, content); a repeated (path, chunk_index) counts as two chunks."""
        index = cls(chunks.sparkSession, path)
        previews = chunks.select("path", "chunk_index", F.size(tokens_of(F.col("content"))).alias("dl"), preview(F.col("content")).alias("preview"))
        previews.repartitionByRange("path", "chunk_index").sortWithinPartitions("path", "chunk_index").write.mode("overwrite").parquet(f"{index.path}/previews")
        found = postings(chunks).repartitionByRange("term", "path", "chunk_index").sortWithinPartitions("term", "path", "chunk_index")
        found.write.mode("overwrite").parquet(f"{index.path}/postings")
        return index

    def _read(self, name: str) -> DataFrame:
        one = lambda part, path: self.spark.read.parquet(f"{path}/{name}").withColumn("path", F.concat(F.lit(f"{part}/"), "path") if part else F.col("path"))
        return functools.reduce(DataFrame.unionByName, (one(part, path) for part, path in sorted(self.parts.items())))

    def postings(self) -> DataFrame:
        return self._read("postings")

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        """(path, chunk_index, score, preview) of the chunks with a positive score, best first; ties by path and index.

        Scores are rounded to nine places, so that ties do not hang on the order in which a sum is taken. The number of
        chunks, their mean length and the query terms' frequencies come back as one row a term. An empty
        query or corpus has no hits."""
        asked = query_terms(query)
        n, mean = self._read("previews").agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
        ours = self.postings().where(F.col("term").isin(sorted(asked)))
        frequency = dict(ours.groupBy("term").agg(F.count(F.lit(1))).collect())
        weights = [(t, asked[t] * math.log(1 + (n - f + 0.5) / (f + 0.5))) for t, f in sorted(frequency.items())]
        weight = F.lit(0.0)
        for t, w in weights:
            weight = F.when(F.col("term") == t, F.lit(w)).otherwise(weight)
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(max(mean, 1.0))))
        scored = ours.groupBy("path", "chunk_index").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
        best = scored.orderBy(F.desc("score"), "path", "chunk_index")
        previews = self._read("previews").select("path", "chunk_index", "preview")
        if limit is not None:
            best = best.limit(limit)
            kept = best.collect()  # at most ``limit`` rows; their paths are pushed down to the previews
            best = self.spark.createDataFrame(kept, best.schema)
            previews = previews.where(F.col("path").isin(sorted({r["path"] for r in kept})))
        return best.join(previews, ["path", "chunk_index"]).select("path", "chunk_index", "score", "preview").orderBy(F.desc("score"), "path", "chunk_index")


def bm25(chunks: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """One search of a corpus without an index; several should share a ``LexicalIndex``."""
    return LexicalIndex.build(chunks, new_folder(chunks.sparkSession, "lexical")).search(query, limit)
