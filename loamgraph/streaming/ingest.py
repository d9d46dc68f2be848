"""Files taken in as they arrive; the engine's batch operators on micro-batches (an addition, not part of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loamgraph.functions.chunking import chunk_documents
from loamgraph.plans.shared import materialize
from loamgraph.sources.embedding import Embedder, embed
from loamgraph.sources.points import Collection, make_points


def stream_texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, text) rows from Parquet files dropped into a folder."""
    return spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_stream(texts: DataFrame, collection: Collection, embedder: Embedder, folder: str, checkpoint: str, chunks_per_file: int | None = None) -> StreamingQuery:
    """Chunk and embed each micro-batch and put it in the place of what its paths had; a batch done twice changes nothing.

    A file that shrinks loses its further chunks, an empty one all. Texts are taken whole, unless ``chunks_per_file``
    bounds them. Of a path that comes several times in a batch one text is taken."""

    def take(batch: DataFrame, _: int) -> None:
        once = materialize(batch.dropDuplicates(["path"]), "batch")
        cut = chunk_documents(once, "path", most=chunks_per_file)
        collection.replace_paths(make_points(embed(cut, "content", embedder), folder), once, folder)

    return texts.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
