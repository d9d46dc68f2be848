"""Problem 7: evaluation texts that stand, wholly or partly, in documents."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.batches import portions
from loamgraph.plans.shared import materialize

#: Words in a shingle; also the shortest run that counts.
RUN = 5
#: Share of an item's words that must stand in a document.
SHARE = 0.6
#: Up to this many item words the sketches are sent to every executor (about 100 bytes a word); beyond, they are joined by shuffle.
BROADCAST_WORDS = 500_000
#: 64-bit words of the filter of item shingles that a larger set sends around (8 MB); if it fills up, more is shuffled.
FILTER_WORDS = 1 << 20
#: Over so many tasks the documents of one shingle or item are spread.
SALT = 16
#: Word hashes a task remembers.
MOST_WORDS = 1_000_000

# Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝмтвнкАВЕКМНОРСТУХІЈЅαορνιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwmtbhkABEKMHOPCTYXIJSaopviABEZHIKMNOPTYX", strict=True))
_LOOKALIKES = str.maketrans(LOOKALIKES)
_UNSEEN = frozenset(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|mark|sub|sup|a|font|small|code|tt)\b[^<>]{0,200}>", re.IGNORECASE)
_BROKEN = re.compile(r"(?<=\w)-[ \t]*(?:\r\n|\r|\n)[ \t>]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text without the way they are written down.

    Entities and tags are resolved, compatibility forms and look-alike letters folded, invisible characters dropped,
    words broken at a line end rejoined, case folded; what is left between letters and digits separates words."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        there = set(text)
        for c in there & _UNSEEN:
            text = text.replace(c, "")
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if not there.isdisjoint(LOOKALIKES):
            text = text.translate(_LOOKALIKES)
    if "-" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.casefold())


def needed(words: int, share: float = SHARE) -> int:
    """How many of so many words have to stand in a document."""
    return max(1, int(np.ceil(share * words - 1e-9)))


def size_class(shingles: int) -> int:
    """Items of one class have between 2^c and 2^(c+1) - 1 shingles."""
    return max(shingles, 1).bit_length() - 1


def class_hits(c: int, share: float = SHARE) -> int:
    """How many sketch hashes a document must share with an item of class ``c``: half of what its shortest items need."""
    return max(1, needed((1 << c) + RUN - 1, share) // (2 * RUN))


def word_hash(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words, which are also entered in ``seen``; none is 0."""
    for w in set(words).difference(seen):
        seen[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1
    return np.array([seen[w] for w in words], dtype=np.uint64)


def shingle_hash(words: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit hash for each run of RUN words, or for those that begin ``at`` the given places."""
    if at is None:
        at = np.arange(max(0, len(words) - RUN + 1))
    out = np.zeros(len(at), np.uint64)
    for i in range(RUN):
        out = (out ^ words[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def known_runs(words: np.ndarray) -> np.ndarray:
    """Where a run of RUN words begins of which none is 0."""
    after = np.concatenate([[0], np.cumsum(words == 0)])
    return np.flatnonzero(after[RUN:] == after[:-RUN]) if len(words) >= RUN else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Item:
    """What the search needs of one item: its words, the sketch and how many of it must be met."""

    words: list[str]
    sketch: np.ndarray
    hits: int


def sketch(at: np.ndarray, often: np.ndarray, words: int, share: float = SHARE) -> tuple[np.ndarray, int]:
    """(hashes, hits): a bottom-k sketch of an item that loses no case.

    ``at`` has the shingle hash of each place, ``often`` the number of items that hold it. The distinct shingles are
    ordered by (often, hash), so that stock phrases of many items come last, and the sketch is the first k. k is the
    least for which a case must meet it ``hits`` times: the shingles left out and the ``hits`` - 1 widest ones
    together cover fewer words than a case has. Runs may overlap in the item and stand apart in the document; a
    shingle that the item repeats covers all its places. ``hits`` is that of the item's size class, less where a few
    shingles alone make a case.
    """
    if not len(at):
        return at, 1
    hashes, first, inverse = np.unique(at, return_index=True, return_inverse=True)
    covers = np.zeros((len(hashes), words), bool)
    for i in range(RUN):
        covers[inverse, np.arange(len(at)) + i] = True
    least = needed(words, share)
    widest = np.concatenate([[0], np.cumsum(np.sort(covers.sum(axis=1))[::-1])])
    hits = int(min(class_hits(size_class(len(at)), share), max(1, np.searchsorted(widest, least, "left"))))
    order = np.lexsort((hashes, often[first]))[::-1]
    left_out = np.logical_or.accumulate(covers[order], axis=0).sum(axis=1)
    k = len(hashes) - int(np.searchsorted(left_out, least - widest[hits - 1], "left"))
    return hashes[order[::-1][:k]], hits


def sketch_items(items: dict[int, list[str]], share: float = SHARE) -> dict[int, Item]:
    """The sketches of items given by their words. Items of fewer than RUN words have none and are never found."""
    seen: dict[str, int] = {}
    at = {k: shingle_hash(word_hash(w, seen)) for k, w in items.items()}
    known, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(h) for h in at.values())]), return_counts=True)
    return {k: Item(w, *sketch(at[k], often[np.searchsorted(known, at[k])], len(w), share)) for k, w in items.items()}


def covered_share(item: list[str], document: set[tuple[str, ...]]) -> float:
    """The exact share of the item's words inside runs that the document holds."""
    inside = np.zeros(len(item), bool)
    for i in range(len(item) - RUN + 1):
        if tuple(item[i : i + RUN]) in document:
            inside[i : i + RUN] = True
    return float(inside.mean()) if item else 0.0


def shingles_of(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(RUN)), strict=False))


class SketchIndex:
    """The items' sketches by size class: a sorted array of hashes and the items that hold each.

    A class is searched in the documents that have as many shingles as it asks hits, so short texts meet the classes of
    short items only."""

    def __init__(self, items: dict[int, Item]):
        self.items = items
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_class: dict[int, list[int]] = defaultdict(list)
        for key, item in items.items():
            if len(item.sketch):
                by_class[item.hits].append(key)
        for hits, keys in by_class.items():
            hashes = np.concatenate([items[k].sketch for k in keys])
            owners = np.repeat(np.array(keys, np.int64), [len(items[k].sketch) for k in keys])
            order = np.argsort(hashes, kind="stable")
            known, begin = np.unique(hashes[order], return_index=True)
            self.classes[hits] = known, np.append(begin, len(order)), owners[order]

    def candidates(self, hashes: np.ndarray, owner: np.ndarray) -> dict[int, list[int]]:
        """Of each owner of ``hashes``, the items of which enough sketch hashes stand among them."""
        found: dict[int, list[int]] = defaultdict(list)
        if not len(hashes):
            return found
        sizes = np.bincount(owner)
        for hits, (known, begin, owners) in self.classes.items():
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            met = np.flatnonzero((known[at] == hashes) & (sizes[owner] >= hits))
            once = np.unique(np.stack([owner[met], at[met]], axis=1), axis=0) if len(met) else np.zeros((0, 2), np.int64)
            counts = Counter((d, k) for d, h in once.tolist() for k in owners[begin[h] : begin[h + 1]].tolist())
            for (d, k), n in counts.items():
                if n >= hits:
                    found[d].append(k)
        return found


RESULT = "doc_id bigint, item_id bigint, share double"


def _search_broadcast(documents: DataFrame, items: dict[int, list[str]], share: float) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(sketch_items(items, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SketchIndex(sent.value)
        seen: dict[str, int] = {}
        word_hash(sorted({w for item in sent.value.values() for w in item.words}), seen)
        for batch in portions(batches):
            rows: list[tuple[int, int, float]] = []
            keys, texts = batch.column(0).to_pylist(), [words_of(t) for t in batch.column(1).to_pylist()]
            # words of no item need not be told apart; a 0 also keeps runs from crossing into the next text
            ids = np.array([n for words in texts for n in (*map(seen.get, words, repeat(0)), 0)], dtype=np.uint64)
            runs = known_runs(ids)
            owner = np.searchsorted(np.cumsum([len(words) + 1 for words in texts]), runs, "right")
            for d, near in index.candidates(shingle_hash(ids, runs), owner).items():
                there = shingles_of(texts[d])
                scored = ((k, covered_share(index.items[k].words, there)) for k in near)
                rows += [(keys[d], k, s) for k, s in scored if s >= share - 1e-9]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "share"])

    return documents.mapInArrow(run, RESULT)


def _hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle hashes of each text by place."""
    seen: dict[str, int] = {}
    for text in texts.to_pylist():
        if len(seen) > MOST_WORDS:
            seen.clear()
        yield shingle_hash(word_hash(words_of(text), seen)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), pa.int32()), pa.array(flat, pa.int64()))


def _bits(shingles: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two places (word, bit) of each hash in a filter of ``words`` 64-bit words."""
    h = shingles.view(np.uint64)
    one, two = h & np.uint64(64 * words - 1), (h >> np.uint64(30)) & np.uint64(64 * words - 1)
    return one >> np.uint64(6), one & np.uint64(63), two >> np.uint64(6), two & np.uint64(63)


def _filter_of(shingles: DataFrame, words: int) -> np.ndarray:
    """A Bloom filter of the column ``shingle``, put together by Spark; ``words`` rows at most come to the driver."""
    place = "struct(shiftright({0} & {1}L, 6) AS word, shiftleft(1L, CAST({0} & 63L AS INT)) AS bit)"
    both = F.expr("explode(array(" + ", ".join(place.format(h, 64 * words - 1) for h in ("shingle", "shiftrightunsigned(shingle, 30)")) + ")) AS x")
    table = shingles.select(both).select("x.*").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(words, np.uint64)
    filled[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return filled


def _search_shuffled(documents: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """The same for item sets of any size; of the documents only hashes that stand in some item are shuffled, no text."""
    spark = documents.sparkSession

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(words_of(t)) for t in batch.column(1).to_pylist()], pa.int32()), _lists(list(_hashes(batch.column(1))))], names=["item_id", "words", "at"])

    ours = materialize(items.mapInArrow(of_items, "item_id bigint, words int, at array<bigint>"), "items")
    placed = ours.select("item_id", "words", F.posexplode("at").alias("place", "shingle"))
    often = placed.select("item_id", "shingle").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    weighed = placed.join(often, "shingle").groupBy("item_id", "words").agg(F.array_sort(F.collect_list(F.struct("place", "shingle", "often"))).alias("all"))

    def of_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, hits = [], []
            for words, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hashes, n = sketch(np.array([r["shingle"] for r in rows], np.int64).view(np.uint64), np.array([r["often"] for r in rows]), words, share)
                kept.append(hashes.view(np.int64))
                hits.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int32()), _lists(kept)], names=["item_id", "hits", "sketch"])

    sketches = materialize(weighed.mapInArrow(of_sketches, "item_id bigint, hits int, sketch array<bigint>"), "sketches")
    sent = spark.sparkContext.broadcast(_filter_of(placed.select("shingle"), FILTER_WORDS))

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in portions(batches):
            kept = []
            for hashes in _hashes(batch.column(1)):
                w1, b1, w2, b2 = _bits(hashes, len(known))
                kept.append(np.unique(hashes[((known[w1] >> b1) & (known[w2] >> b2) & np.uint64(1)).astype(bool)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(kept)], names=["doc_id", "there"])

    theirs = documents.mapInArrow(of_documents, "doc_id bigint, there array<bigint>").where("size(there) > 0")
    theirs = materialize(theirs.withColumn("key", F.xxhash64("doc_id", "there")), "documents")
    # a shingle in a third of the documents is spread over SALT tasks; so is an item
    salt = lambda: F.pmod(F.col("key"), F.lit(SALT)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    asked = sketches.select("item_id", "hits", F.explode("sketch").alias("shingle")).select("*", salts)
    met = theirs.select("key", "doc_id", salt(), F.explode("there").alias("shingle")).join(asked, ["shingle", "salt"])
    near = met.groupBy("key", "doc_id", "item_id").agg(F.count(F.lit(1)).alias("met"), F.max("hits").alias("hits")).where("met >= hits").select("key", "doc_id", "item_id", salt())
    whole = ours.select("item_id", "words", "at", salts)
    both = near.join(whole, ["item_id", "salt"]).join(theirs.select("key", "doc_id", "there"), ["key", "doc_id"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for words, at, there in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                inside = np.zeros(words, bool)
                for place in np.flatnonzero(np.isin(at.values.to_numpy(), there.values.to_numpy())):
                    inside[place : place + RUN] = True
                shares.append(float(inside.mean()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=["doc_id", "item_id", "share"])

    return both.select("doc_id", "item_id", "words", "at", "there").mapInArrow(verify, RESULT).where(F.col("share") >= share - 1e-9)


def leaked_items(documents: DataFrame, items: DataFrame, *, share: float = SHARE, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, share): documents holding at least ``share`` of an item's words in runs of RUN or more.

    Containment search: each item has a bottom-k MinHash sketch by its size (``sketch``), the sketches are indexed
    by size class, and a document is a candidate for the items of which enough sketch hashes stand among its shingles.
    The choice of k makes candidates complete; the exact share of covered words then decides. Documents of any length
    are read whole, once.

    The items' size is counted first. Up to ``broadcast_words`` words they are sent to the executors and nothing but
    the result is shuffled; a larger item set is joined by shingle, with the same result. Null and empty texts, items
    under RUN words and null ids give no rows; of items with equal ids the greatest text stands; a row appears once
    for a (doc_id, item_id) even where rows are repeated, with the largest share of the document's texts.
    """
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    tests = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.max("text").alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 6
    if size <= broadcast_words:
        found = _search_broadcast(docs, {key: words_of(text) for key, text in tests.collect()}, share)  # bounded by broadcast_words
    else:
        found = _search_shuffled(docs, tests, share)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
