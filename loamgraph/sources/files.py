"""Reading a folder of files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.functions.text import INGESTED, SKIPPED_FOLDERS, ending_of, kind_of, strip_html, walked, with_slashes
from loamgraph.functions.whitespace import trim_spaces
from loamgraph.plans.shared import _hadoop_path

MOST_FILES, TEXT_BYTES, PDF_BYTES = 10_000, 2_000_000, 32_000_000


def list_files(root: str, most: int | None = MOST_FILES) -> tuple[list[str], bool]:
    """Paths of regular files under a local root, relative and with ``/``, and whether the cap cut any off.

    Skipped folders are not entered, temporary office files and links left out, hidden files kept, unreadable folders
    passed over."""
    found: list[str] = []
    for folder, inside, names in os.walk(root, onerror=lambda _: None):
        inside[:] = sorted(d for d in inside if not (d.startswith(".") or d.endswith("_files") or d in SKIPPED_FOLDERS))
        for name in sorted(names):
            whole = os.path.join(folder, name)
            if name.startswith("~$") or os.path.islink(whole) or not os.path.isfile(whole):
                continue
            if most is not None and len(found) >= most:
                return found, True
            found.append(os.path.relpath(whole, root).replace(os.sep, "/"))
    return found, False


def _literal(root: str) -> str:
    """The root with the characters that Spark takes for patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", root)


def read_folder(spark: SparkSession, root: str, *, glob: str | None = None) -> DataFrame:
    """(path, length, modified, content) of every file, read by the executors; the content is only loaded where selected.

    Spark's source lists no names beginning with ``_`` or ``.``; those are listed here and read by path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    where, fs = _hadoop_path(spark, root)
    # Spark names files by the address of the root and what comes after it, so that much is cut off
    base = fs.makeQualified(where).toString().rstrip("/") + "/"
    rel = with_slashes(F.expr(f"substring(path, {len(base) + 1})"))
    files = reader.load(_literal(root)).select(rel.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    return files.where(walked(F.col("path"))).unionByName(_read_hidden(spark, root, glob))


def _left_out(name: str) -> bool:
    """Whether Spark's file sources pass over a file or folder of this name."""
    return (name.startswith("_") and "=" not in name and not name.startswith(("_common_metadata", "_metadata"))) or name.startswith(".") or name.endswith("._COPYING_")


def _hidden_local(root: str) -> list[tuple[str, int, float]]:
    names = [n for n in list_files(root, None)[0] if any(map(_left_out, n.split("/")))]
    return [(n, at.st_size, at.st_mtime) for n in names for at in [os.stat(os.path.join(root, n))]]


def _hidden_remote(where, fs) -> list[tuple[str, int, float]]:
    """The same by the Hadoop file system."""
    found, open_ = [], [(where, "", False)]
    while open_:
        folder, base, hidden = open_.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if status.isDirectory():
                if not (name.startswith(".") or name.endswith("_files") or name in SKIPPED_FOLDERS):
                    open_.append((status.getPath(), f"{base}{name}/", hidden or _left_out(name)))
            elif status.isFile() and not name.startswith("~$") and (hidden or _left_out(name)):
                found.append((base + name, status.getLen(), status.getModificationTime() / 1000))
    return found


def _read_hidden(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    where, fs = _hadoop_path(spark, root)
    whole = fs.makeQualified(where).toUri()
    local = fs.getScheme() == "file"
    base = whole.getPath() if local else whole.toString()
    found = _hidden_local(base) if local else _hidden_remote(where, fs)
    if glob:
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob)
        found = [row for row in found if pattern.matches(row[0].rsplit("/", 1)[-1])]

    @F.udf(T.BinaryType())
    def content(path):
        if local:
            with open(os.path.join(base, path), "rb") as file:
                return file.read()
        from pyarrow.fs import FileSystem

        store, folder = FileSystem.from_uri(base)
        with store.open_input_stream(f"{folder.rstrip('/')}/{path}") as file:
            return file.read()

    rows = spark.createDataFrame(found, "path string, length bigint, seconds double")
    return rows.select("path", "length", F.timestamp_seconds("seconds").alias("modified"), content("path").alias("content"))


def read_texts(files: DataFrame, pdf_text: Callable[[bytes], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, kind, text) of the files that can be read, and (path, reason) of the others.

    Text files above 2 MB and PDFs above 32 MB are too large, other bytes than UTF-8 no text, blank ones empty; markup
    is stripped from HTML. PDFs need an extractor, given as a function of bytes.
    """
    typed = files.withColumn("ending", ending_of(F.col("path"))).withColumn("kind", kind_of(F.col("ending"))).where(F.col("kind").isin(*INGESTED))
    limit = F.when(F.col("kind") == "pdf", PDF_BYTES).otherwise(TEXT_BYTES)
    large = F.col("length") > limit
    skipped = typed.where(large).select("path", F.concat(F.lit("too large ("), F.col("length").cast("string"), F.lit(" bytes)")).alias("reason"))
    small = typed.where(~large)
    plain = small.where(F.col("kind") != "pdf").withColumn("fine", F.expr("is_valid_utf8(content)"))
    skipped = skipped.unionByName(plain.where("NOT fine").select("path", F.lit("not valid UTF-8").alias("reason")))
    body = F.col("content").cast("string")
    texts = plain.where("fine").select("path", "kind", F.when(F.col("kind") == "html", strip_html(body)).otherwise(body).alias("text"))
    pdfs = small.where(F.col("kind") == "pdf")
    if pdf_text is None:
        skipped = skipped.unionByName(pdfs.select("path", F.lit("pdf: no extractor").alias("reason")))
    else:

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: list[tuple[str | None, str | None]] = []
                for content in batch.column(1).to_pylist():
                    try:
                        found.append((pdf_text(content), None))
                    except Exception as error:
                        found.append((None, f"pdf: {error}"))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], pa.string()) for i in range(2))], names=["path", "text", "reason"])

        read = pdfs.select("path", "content").mapInArrow(extract, "path string, text string, reason string").withColumn("kind", F.lit("pdf"))
        texts = texts.unionByName(read.where("reason IS NULL").select("path", "kind", "text"))
        skipped = skipped.unionByName(read.where("reason IS NOT NULL").select("path", "reason"))
    blank = trim_spaces(F.col("text")) == ""
    skipped = skipped.unionByName(texts.where(blank).select("path", F.concat("path", F.lit(": empty")).alias("reason")))
    return texts.where(~blank), skipped
