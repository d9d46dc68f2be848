"""Problem 8: how demanding each document is to read."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.batches import portions
from loamgraph.plans.shared import materialize

#: Share of a language's documents that a familiar word stands in. A list has so at most 1 / FAMILIAR_SHARE times as many
#: words as a document has different ones on average, and can be sent to every executor.
FAMILIAR_SHARE = 0.2
#: The share of unfamiliar words is drawn to that of all documents as by so many further words, which matters for short texts.
DRAWN = 10
#: Constant, weight of the unfamiliar share and of a word a sentence in school grades, from a published
#: familiar-word formula (2 * (15.79 * share + 0.0496 * length + 3.6365) - 5).
PUBLISHED = (2.273, 31.58, 0.0992)
#: All documents together, graded by the published formula, weigh as much as so many documents graded by readers.
PRIOR = 1.0
#: Grades further off than this weigh less, in proportion.
FAR = 2.0
GRADE = 13
#: A language with fewer documents has no list: each word of one document would reach FAMILIAR_SHARE.
LEAST_LISTED = 50

_FENCE = re.compile(r"^(```|~~~).*?^\1[^\n]*$|^(?:```|~~~).*\Z", re.MULTILINE | re.DOTALL)
_LINE_END = re.compile(r"\r\n|[\r\x85\u2028\u2029]")
# What is not the document's own prose, by the start of its line: quotations, tables, headings, lists, logs, fields.
_OTHER = re.compile(r"^[ \t]*(?:>|\||#{1,6}[ \t]|[-*+•–][ \t]|\d{1,3}[.)][ \t]|\[?\d{1,2}:\d{2}|\d{4}-\d\d-\d\d|[A-Z][a-z]+: |See \[|<[a-z/!])|^(?: {4}|\t)\S")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_LOWER = re.compile(r"(?<![^\W_])[a-zß-öø-ÿ]+(?:[-'’][a-zß-öø-ÿ]+)*(?![^\W_])")
_FIRST = re.compile(r"(?:^|[.!?][\"'”’)\]]*\s+)[\"'“‘(]*([^\W\d_a-z][^\W\d_]*(?:[-'’][^\W\d_]+)*)")
_END = re.compile(r"[.!?]+[\"'”’)\]]*(?:\s+(?![a-z])|\s*$)")
# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset("cf sect esp fig figs i.e e.g vs pp p ff vol vols no nos etc al dr mr mrs ms prof st jr sr inc ltd approx ca ed eds ch sec eq ref refs univ dept".split())


def own_prose(text: str | None) -> list[str]:
    """The paragraphs of running text: without code, quotations, tables, headings, lists, logs and fields."""
    if not text:
        return []
    text = _LINE_END.sub("\n", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("", text)
    paragraphs, lines = [], []
    for line in [*text.split("\n"), ""]:
        if not line.strip() or _OTHER.match(line):
            if lines:
                paragraphs.append(" ".join(lines))
                lines = []
        else:
            lines.append(line.strip())
    return paragraphs


def sentences(paragraph: str) -> list[str]:
    """Complete sentences: with a full stop, question or exclamation mark, and not begun in lower case like a list."""
    out, begin = [], 0
    for m in _END.finditer(paragraph):
        if paragraph[m.start()] == ".":
            last = paragraph[max(begin, paragraph.rfind(" ", begin, m.start()) + 1) : m.start()].lstrip("(")
            if last.lower() in ABBREVIATIONS or (len(last) == 1 and last.isalpha()):
                continue
        first = _WORD.search(paragraph, begin, m.end())
        if first and not first[0][0].islower():
            out.append(paragraph[begin : m.end()])
        begin = m.end()
    return out


def plain_words(text: str) -> list[str]:
    """Lower-case words, without names: words with a capital that do not begin a sentence."""
    if text.isupper():
        text = text.lower()
    return _LOWER.findall(text) + [w.lower() for w in _FIRST.findall(text)]


def prose_words(paragraphs: list[str]) -> list[str]:
    return [w for p in paragraphs for w in plain_words(p)]


def sentence_lengths(paragraphs: list[str]) -> list[int]:
    """The words in each complete sentence."""
    return [n for p in paragraphs for s in sentences(p) if (n := len(_WORD.findall(s))) > 0]


PARSED = "doc_id bigint, lang string, n_words int, n_sentences int, sentence double, words array<string>, times array<int>"


def parse(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, n_sentences, sentence, words, times): what a document's own prose is made of.

    ``sentence`` is the mean of words a complete sentence, 0 without one and null without words; ``words`` are the
    different words with how often each stands. This is the only pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            words, times, ends, sizes, lengths = [], [], [0], [], []
            for text in batch.column(2).to_pylist():
                paragraphs = own_prose(text)
                counts = Counter(prose_words(paragraphs))
                words += counts.keys()
                times += counts.values()
                ends.append(len(words))
                sizes.append(counts.total())
                lengths.append(sentence_lengths(paragraphs))
            means = [sum(n) / len(n) if n else (0.0 if size else None) for n, size in zip(lengths, sizes, strict=True)]
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in ((words, pa.string()), (times, pa.int32()))]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array([len(n) for n in lengths], pa.int32()), pa.array(means, pa.float64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "n_words", "n_sentences", "sentence", "words", "times"])

    return documents.select(F.col("doc_id").cast("bigint"), "lang", "text").mapInArrow(run, PARSED)


def familiar_words(parsed: DataFrame, *, share: float = FAMILIAR_SHARE, least: int = LEAST_LISTED) -> dict[str, list[str]]:
    """The high-frequency list of each language with at least ``least`` documents: words in at least ``share`` of them.

    Document frequencies are counted over all documents with words, and summed before the shuffle."""
    spoken = parsed.where("lang IS NOT NULL AND n_words > 0")
    totals = spoken.groupBy("lang").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least)
    counts = spoken.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    often = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= share * F.col("total"))  # one row a language
    lists: dict[str, list[str]] = {lang: [] for lang, _ in totals.collect()}
    for lang, word in often.select("lang", "word").orderBy("lang", "word").collect():  # see FAMILIAR_SHARE for their number
        lists[lang].append(word)
    return lists


FEATURES = "doc_id bigint, lang string, n_words int, n_sentences int, unfamiliar double, sentence double"


def features(parsed: DataFrame, familiar: dict[str, list[str]]) -> DataFrame:
    """(doc_id, lang, n_words, n_sentences, unfamiliar, sentence): share of words outside the list of the language.

    Without a language it is the least of all lists; without a list, or without words, it is null."""
    sent = parsed.sparkSession.sparkContext.broadcast(familiar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {lang: pa.array(words, pa.string()) for lang, words in sent.value.items()}
        for batch in batches:
            sizes = np.array(batch.column(2).to_pylist(), float)
            words, times = batch.column(5).flatten(), batch.column(6).flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(5).offsets.to_numpy()))
            langs = np.array(batch.column(1).to_pylist(), object)
            unfamiliar = np.full(batch.num_rows, np.nan)
            for lang, known in lists.items():
                ours = (langs == lang) | (langs == None)  # noqa: E711
                if ours.any():
                    new = ~pc.is_in(words, value_set=known).to_numpy(zero_copy_only=False)
                    share = np.bincount(owner, weights=times * new, minlength=batch.num_rows) / np.maximum(sizes, 1)
                    unfamiliar[ours] = np.fmin(unfamiliar[ours], share[ours])
            unfamiliar[sizes == 0] = np.nan
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(unfamiliar, pa.float64(), from_pandas=True), batch.column(4)], names=["doc_id", "lang", "n_words", "n_sentences", "unfamiliar", "sentence"])

    return parsed.select("doc_id", "lang", "n_words", "n_sentences", "sentence", "words", "times").mapInArrow(run, FEATURES)


@dataclass(frozen=True)
class Formula:
    """level = constant + of_words * share of unfamiliar words + of_length * words a sentence; demanding from ``cut`` on."""

    constant: float
    of_words: float
    of_length: float
    cut: float
    usual: float

    def share(self) -> Column:
        return (F.col("unfamiliar") * F.col("n_words") + DRAWN * F.lit(self.usual)) / (F.col("n_words") + DRAWN)

    def level(self) -> Column:
        return F.lit(self.constant) + F.lit(self.of_words) * self.share() + F.lit(self.of_length) * F.col("sentence")


def _sums(rows: DataFrame, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy of the columns u, s and grade."""
    x = [F.lit(1.0), F.col("u"), F.col("s")]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    row = rows.agg(*(F.coalesce(F.sum(weight * x[i] * x[j]), F.lit(0.0)) for i, j in pairs), *(F.coalesce(F.sum(weight * c * F.col("grade")), F.lit(0.0)) for c in x)).first()
    square = np.zeros((3, 3))
    for (i, j), v in zip(pairs, row[:6], strict=True):
        square[i, j] = square[j, i] = v
    return square, np.array(row[6:], float)


def _histogram(rows: DataFrame, estimate: Column) -> np.ndarray:
    """How many documents below and from GRADE on have each estimate, in tenths from 0 to 30."""
    tenth = F.floor(10 * F.least(F.greatest(estimate, F.lit(0.0)), F.lit(30.0))).cast("int")
    out = np.zeros((2, 302))
    for at, low, high in rows.groupBy(tenth.alias("at")).agg(F.count_if(F.col("grade") < GRADE), F.count_if(F.col("grade") >= GRADE)).collect():  # at most 301 rows
        out[:, at] = low, high
    return out


def fit(measured: DataFrame, labels: DataFrame) -> Formula:
    """The formula that fits the readers' grades.

    Grades outside 1 to 17 are left out, repeated rows count once, and a document has the median of its grades. The
    weights are least squares by sums that Spark adds up, twice more with grades that are FAR off weighing less. All
    measured documents, graded by the published formula, take part with the weight of PRIOR documents, so that the
    same holds for any number of labels: without any, the formula is the published one. The cut is the estimate that
    best tells grade 13 and up from the rest (the middle, if several do).
    """
    graded = labels.where("grade BETWEEN 1 AND 17 AND doc_id IS NOT NULL").select("doc_id", "rater", "grade").distinct().groupBy("doc_id").agg(F.percentile("grade", 0.5).alias("grade"))
    known = measured.where("unfamiliar IS NOT NULL")
    n, usual = known.agg(F.count(F.lit(1)), F.coalesce(F.avg("unfamiliar"), F.lit(0.0))).first()
    plain = Formula(*PUBLISHED, float(GRADE), usual)
    every = known.select("doc_id", plain.share().alias("u"), F.col("sentence").alias("s"))
    rows = materialize(every.join(graded, "doc_id"), "graded")
    assumed = every.withColumn("grade", F.lit(PUBLISHED[0]) + PUBLISHED[1] * F.col("u") + PUBLISHED[2] * F.col("s"))
    prior = [PRIOR / max(n, 1) * part for part in _sums(assumed, F.lit(1.0))]
    w, weight = np.array(PUBLISHED), F.lit(1.0)
    estimate = lambda w: F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("u") + F.lit(float(w[2])) * F.col("s")
    for _ in range(3):
        square, product = _sums(rows, weight)
        w = w if not n else np.linalg.lstsq(square + prior[0], product + prior[1], rcond=None)[0]
        weight = F.lit(FAR) / F.greatest(F.abs(estimate(w) - F.col("grade")), F.lit(FAR))
    low, high = _histogram(rows, estimate(w)) + PRIOR / max(n, 1) * _histogram(assumed, estimate(w))
    errors = np.concatenate([[0], np.cumsum(high)]) + (low.sum() - np.concatenate([[0], np.cumsum(low)]))
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    return Formula(*map(float, w), float(best[len(best) // 2]) / 10, usual)


def _levels(measured: DataFrame, formula: Formula) -> DataFrame:
    leveled = measured.withColumn("level", formula.level()).withColumn("demanding", F.coalesce(F.col("level") >= formula.cut, F.lit(False)))
    return leveled.select("doc_id", "n_words", "n_sentences", "unfamiliar", "sentence", "level", "demanding")


def reading_levels(documents: DataFrame, labels: DataFrame, *, lang: str = "en") -> DataFrame:
    """(doc_id, n_words, n_sentences, unfamiliar, sentence, level, demanding) of the documents in ``lang``.

    A familiar-word formula: ``level`` = constant + weight * share of words outside the high-frequency list + weight *
    mean words a sentence, with weights from the readers' grades. ``demanding`` is true where the level reaches the cut
    for more than secondary school. Texts without words of their own, null and empty ones among them, have a null level
    and are not demanding; texts of any length are read whole, once, and not shuffled.
    """
    parsed = materialize(parse(documents.where(F.col("lang") == lang)), "parsed")
    measured = materialize(features(parsed, familiar_words(parsed, least=1)), "measured")
    return _levels(measured, fit(measured, labels))


def all_reading_levels(documents: DataFrame, labels: DataFrame, *, lang: str = "en") -> DataFrame:
    """The columns of ``reading_levels`` for every document, those in ``lang`` as there.

    Each language has a familiar-word list of its own; the weights and the cut are those of ``lang``, the only one with
    grades. A document without a language has the list that leaves the fewest of its words unfamiliar. In a language of
    fewer than LEAST_LISTED documents the unfamiliar share and the level are null, as there is no list."""
    parsed = materialize(parse(documents), "parsed")
    lists = familiar_words(parsed)
    if lang not in lists:
        lists |= familiar_words(parsed.where(F.col("lang") == lang), least=1)
    measured = materialize(features(parsed, lists), "measured")
    return _levels(measured, fit(measured.where(F.col("lang") == lang), labels))
