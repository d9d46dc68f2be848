"""Problem 5: source files that nobody on the project wrote by hand."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.batches import portions
from loamgraph.plans.shared import materialize

#: Tokens in a fingerprinted gram: several functions' worth, so that idioms do not fill one however many files there are.
GRAM = 56
#: Of so many successive grams winnowing keeps at least one; a shared run of GRAM + WINDOW - 1 tokens is never missed.
WINDOW = 8
#: A file with fewer tokens than a gram has one fingerprint, that of all its tokens; with fewer than this it has none.
LEAST_TOKENS = 28
#: A fingerprint recurs if it stands in files of so many repositories.
REPOSITORIES = 3
#: Share of a file's fingerprints that must recur; of short files, in which idioms weigh more, a larger one.
RECURRING, RECURRING_SHORT, SHORT = 0.5, 0.65, 14
#: A file of which so much stands in another repository is a copy even if there is only one other.
WHOLE = 0.9

# Folders that hold copies of other projects, output of generators, and names of built files.
_VENDOR = re.compile(r"(?:^|/)(?:vendor|vendored|third[-_]?party|3rd[-_]?party|extern|externals?|deps|node_modules|bower_components|contrib|imported)/[^/]+/", re.IGNORECASE)
_GENERATED_PATH = re.compile(r"(?:^|/)(?:gen|generated|autogen|auto[-_]generated|codegen|__generated__)/(?:.*/)?[^/]+$|\.(?:gen|generated|g|pb|tab|yy|lex)\.[a-z]+$|_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h)$", re.IGNORECASE)
_BUILT = re.compile(r"(?:[.-]min|\.bundle|\.chunk|\.prod|\.umd)\.[cm]?jsx?$|(?:^|/)[\w-]+\.[0-9a-f]{6,}\.[cm]?js$", re.IGNORECASE)
# How generators mark what they write, in the project's languages.
_MARK = re.compile(
    r"\bauto-?\s?generated\b|@generated\b|\bgenerated (?:by|from|with|using)\b|\bmachine[- ](?:written|generated|made)\b|\bdo not (?:edit|modify|change)\b"
    r"|\bautomati(?:sch|quement|camente)\b.{0,60}\b(?:erzeugt|erstellt|g[ée]n[ée]r\w*|produi\w*|generad\w*)\b|\b(?:fichier|archivo) (?:est )?(?:produit|g[ée]n[ée]r[ée]|generado|producido)\b"
    r"|\bnicht (?:bearbeiten|[äa]ndern)\b|\bne pas (?:modifier|[ée]diter)\b|\bno (?:editar|modificar)\b",
    re.IGNORECASE,
)
_NO_MARK = re.compile(r"\bnot (?:auto-?)?generated\b|[\"'“][^\"']*(?:generated|do not edit)[^\"']*[\"'”]", re.IGNORECASE)
#: A release of a project, named in the comment that a file begins with.
_RELEASE = re.compile(r"\b([A-Z][\w-]+) v?\d+\.\d+(?:\.\d+)*\b")
_COMMENT_LINE = re.compile(r"^\s*(?://|#(?!include|define|if|endif|else|pragma|!)|/\*|\*|--|;|\"\"\"|<!--)")
_BLOCK = re.compile(r"/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''", re.DOTALL)
_TO_END = re.compile(r"(?m)//[^\n]*$|^\s*#(?!include|define)[^\n]*$")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NUMBERED = re.compile(r"[A-Za-z]_?\d+\b")
_LITERAL = re.compile(r"\"[^\"]*(?:\"|\Z)|'[^'\n]*'|[-+]?\b(?:0[xX][0-9a-fA-F]+|\d[\d.]*(?:[eE][-+]?\d+)?)[fFuUlL]*\b|\b(?:true|false|null|None|nil)\b")


def repository_of(path: Column) -> Column:
    """The project a path belongs to: its first folder."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def merge_chunks(chunks: list[tuple[int, str]]) -> str:
    """The text of a file from its chunks in order, with the overlap of neighbours kept once."""
    text, last = "", None
    for index, content in chunks:
        if text and last is not None and index == last + 1:
            most = min(len(text), len(content), 400)
            head, over = content, 0
            for n in range(most, 11, -1):
                if text.endswith(head[:n]):
                    over = n
                    break
            text += ("" if over else "\n") + content[over:]
        else:
            text += ("\n" if text else "") + content
        last = index
    return text


def is_generated(text: str) -> bool:
    """A generator's mark in a comment, or many members told apart by numbers only."""
    lines = [line for line in text.splitlines() if line.strip()]
    for line in lines:
        if _COMMENT_LINE.match(line) and _MARK.search(line) and not _NO_MARK.search(line):
            return True
    if len(lines) < 20:
        return False
    numbered = [line for line in lines if _NUMBERED.search(line)]
    shapes = {re.sub(r"\w*\d+\w*", "0", re.sub(r"[A-Za-z]+_?\d+", "0", line.strip())) for line in numbered}
    return len(numbered) >= 0.4 * len(lines) and len(shapes) <= 0.4 * len(numbered)


def is_minified(text: str) -> bool:
    """Long lines with hardly any white space outside their strings."""
    lines = [line for line in text.splitlines() if line.strip()]
    bulk = [line for line in lines if len(line) >= 200]
    size = sum(map(len, bulk))
    if size < 0.6 * sum(map(len, lines)) or not bulk:
        return False
    code = re.sub(r"\"[^\"]*\"|'[^']*'", '""', " ".join(bulk))
    spaces = sum(c in " \t" for c in code)
    return len(code) > 0.5 * size and spaces < 0.09 * len(code) and sum(c in "{}();=," for c in code) > 0.12 * len(code)


def is_data(text: str) -> bool:
    """Hardly anything but literals, and more than a few of them."""
    bare = _TO_END.sub("", text)
    rest, literals = _LITERAL.subn("", bare)
    names = sum(c.isalnum() or c == "_" for c in rest)
    return len(bare) >= 400 and (literals >= 5 or len(rest) <= 0.2 * len(bare)) and names <= 0.12 * len(re.sub(r"\s", "", bare))


def names_release(path: str, text: str) -> bool:
    """Whether the comment a file begins with names a release of a project other than its repository."""
    header = []
    for line in text.splitlines():
        if not _COMMENT_LINE.match(line):
            break
        header.append(line)
    own = path.split("/", 1)[0].lower()
    return any(m[1].lower() not in own for m in _RELEASE.finditer("\n".join(header)))


def reason_of(path: str, text: str) -> str | None:
    """Why a file by itself is not hand-written, or null. What the text shows goes before what the path says."""
    if text:
        if is_generated(text):
            return "generated"
        if is_minified(text):
            return "minified"
        if is_data(text):
            return "data"
        if names_release(path, text):
            return "third party"
    if _BUILT.search(path):
        return "minified"
    if _VENDOR.search(path):
        return "third party"
    return "generated" if _GENERATED_PATH.search(path) else None


def fingerprints(text: str, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Winnowed 64-bit fingerprints of the token stream without comments, white space and case.

    A stream shorter than a gram, but of LEAST_TOKENS, has one of the whole of it."""
    tokens = _TOKEN.findall(_TO_END.sub("", _BLOCK.sub("", text)).lower())
    if LEAST_TOKENS <= len(tokens) < gram:
        gram = len(tokens)
    n = len(tokens) - gram + 1
    if n < 1:
        return np.zeros(0, np.int64)
    seen: dict[str, int] = {}
    for t in set(tokens):
        seen[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    ids = np.array([seen[t] for t in tokens], dtype=np.uint64)
    # a polynomial over the gram from prefix sums, modulo 2^64; the odd base has an inverse, which moves every gram to 0
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * np.cumprod(np.full(len(ids), _BASE)))])
        out = (sums[gram:] - sums[:-gram]) * np.cumprod(np.full(n, _INVERSE))
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    if n <= window:
        return np.array([out.min()]).view(np.int64)
    least = np.lib.stride_tricks.sliding_window_view(out, window).min(axis=1)
    return np.unique(least).view(np.int64)


FILES = "path string, reason string, fingerprints array<bigint>"


def examine(files: DataFrame) -> DataFrame:
    """(path, reason, fingerprints) of files given as (path, chunks array<struct<chunk_index, content>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            paths, reasons, prints = [], [], []
            for path, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = merge_chunks(sorted({(c["chunk_index"], c["content"]) for c in chunks or []}))
                paths.append(path)
                reasons.append(reason_of(path, text))
                prints.append(fingerprints(text).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(reasons, pa.string()), pa.array(prints, pa.list_(pa.int64()))], names=["path", "reason", "fingerprints"])

    return files.select("path", "chunks").mapInArrow(run, FILES)


def code_files(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, chunks) of the nodes of kind ``code``, with the chunks that are kept of each; paths with ``/``.

    Chunks whose path has an ending that no code node has are left before the shuffle, and repeated rows by a set.
    Files without chunks have null; null paths and contents are no rows."""
    one = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    ending = lambda c: F.element_at(F.split(c, r"[./\\]"), -1).alias("ending")
    code = nodes.where((F.col("kind") == "code") & F.col("id").isNotNull()).select(one("id").alias("path")).distinct()
    full = chunks.where("content IS NOT NULL AND content <> '' AND chunk_index IS NOT NULL").select("path", "chunk_index", "content", ending("path"))
    ours = full.join(code.select(ending("path")).distinct(), "ending", "left_semi")
    kept = ours.groupBy(one("path").alias("path")).agg(F.collect_set(F.struct("chunk_index", "content")).alias("chunks"))
    return code.join(kept, "path", "left")


def not_by_hand(nodes: DataFrame, chunks: DataFrame, *, repositories: int = REPOSITORIES) -> DataFrame:
    """(path, reason, share) of code files that nobody wrote by hand; ``reason`` is copy, generated, minified, data or third party.

    ``share`` is the part of the file's winnowed fingerprints that stand in files of at least ``repositories``
    repositories; from RECURRING on (RECURRING_SHORT with fewer than SHORT fingerprints), or from WHOLE on in any two,
    the file is a copy. What is no copy is judged by itself (``reason_of``). A repository counts once for a fingerprint,
    which also takes the weight from a repository full of one file; these counts are summed before the shuffles, so a
    fingerprint of a third of all files is one row a repository. Files of fewer than LEAST_TOKENS tokens, like package
    markers, have no fingerprint and are no copies, however many there are.
    """
    # numbers stand for paths and repositories in what is shuffled by fingerprint
    files = materialize(examine(code_files(nodes, chunks)).withColumn("file", F.monotonically_increasing_id()), "files")
    prints = files.select("file", F.xxhash64(repository_of(F.col("path"))).alias("repository"), F.explode("fingerprints").alias("print"))
    common = prints.groupBy("print", "repository").agg(F.lit(1).alias("one")).groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = prints.select("file", "print").join(common, "print").groupBy("file").agg(F.count_if(F.col("n") >= repositories).alias("met"), F.count(F.lit(1)).alias("twice"))
    shared = files.select("file", "path", "reason", F.size("fingerprints").alias("size")).join(met, "file", "left").withColumn("share", F.coalesce(F.col("met") / F.col("size"), F.lit(0.0)))
    enough = F.when(F.col("size") < SHORT, RECURRING_SHORT).otherwise(RECURRING)
    copied = (F.col("share") >= enough) | (F.col("twice") >= WHOLE * F.col("size"))
    return shared.withColumn("reason", F.when(copied, "copy").otherwise(F.col("reason"))).where("reason IS NOT NULL").select("path", "reason", "share")
