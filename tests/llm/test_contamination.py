"""Problem 7: containment search against brute force, by both ways of joining."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loamgraph.llm import contamination as c

WORDS = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mu") for b in ("ran", "sel", "tip", "von")]
ITEMS = "item_id bigint, suite string, text string, doc_id bigint, share double"
DOCS = "doc_id bigint, text string, lang string, item_id bigint"


def brute(docs, items, share=c.SHARE):
    found = set()
    for d, text in docs:
        there = c.shingles_of(c.words_of(text))
        for i, item in items:
            words = c.words_of(item)
            if d is not None and i is not None and len(words) >= c.RUN and c.covered_share(words, there) >= share - 1e-9:
                found.add((d, i))
    return found


def made(seed=1):
    rnd = random.Random(seed)
    some = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [(i, "Which of these " + some(rnd.randrange(2, 40))) for i in range(30)] + [(90, "too short"), (91, None), (92, ""), (None, some(20)), (93, "go " * 30)]
    docs = [(0, None), (1, ""), (2, some(3000)), (None, some(9)), (3, "go " * 4000)]
    for d in range(10, 130):
        words = (rnd.choice(items[:30])[1]).split()
        a = rnd.randrange(0, len(words) // 3 + 1)
        b = rnd.randrange(a, len(words) + 1)
        part = words[a:b]
        if rnd.random() < 0.5 and len(part) > 8:
            part[rnd.randrange(len(part))] = "xx"
        docs.append((d, some(60) + " " + rnd.choice([" ", ", ", " … ", " "]).join(part).upper() + " " + some(60)))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "en", 1) for d, t in docs + docs[:9]], DOCS), spark.createDataFrame([(i, "s", t, 5, 0.1) for i, t in items], ITEMS)


def test_both_ways_find_all(spark):
    docs, items = made()
    want = brute(docs, items)
    assert len(want) > 15
    d, i = frames(spark, docs, items)
    for words in (c.BROADCAST_WORDS, 0):
        found = [(r["doc_id"], r["item_id"]) for r in c.leaked_items(d, i, broadcast_words=words).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_empty_tables(spark):
    docs, items = made()
    d, i = frames(spark, docs, items)
    assert c.leaked_items(d.limit(0), i).count() == c.leaked_items(d, i.limit(0)).count() == c.leaked_items(d.limit(0), i.limit(0), broadcast_words=-1).count() == 0


def test_ways_of_writing():
    plain = "one two three four five six seven".split()
    for text in ("ONE, two - three​ fo­ur five … six seven", "> one two thr-\n> ee four five\n> six seven", "<b>one</b>&nbsp;**two** three four fivе six seven", "one two ｔｈｒｅｅ four five six seven"):
        assert c.words_of(text) == plain


def overlapping(n, apart=0, most=2000):
    """An item of n words and documents with two of its runs of five, which may overlap in it but stand apart."""
    item = [f"w{i}" for i in range(n)]
    docs = []
    for a in range(n - 4):
        for b in range(a + apart, n - 4):
            docs.append([*item[a : a + 5], "gap", *item[b : b + 5]])
    return item, docs[:most]


@pytest.mark.parametrize("n", [5, 6, 8, 9, 14, 15, 16, 23])
def test_runs_that_overlap_in_the_item_are_met(n):
    words, docs = overlapping(n)
    item = c.sketch_items({1: words})[1]
    for document in docs:
        if c.covered_share(words, c.shingles_of(document)) >= 0.6:
            met = set(c.shingle_hash(c.word_hash(document, {})).tolist()) & set(item.sketch.tolist())
            assert len(met) >= item.hits


def test_overlapping_runs_by_both_ways(spark):
    items, docs = [], []
    for n in (9, 14, 15, 23):
        words, texts = overlapping(n)
        items.append((n, " ".join(f"{w}x{n}" for w in words)))
        docs += [(1000 * n + i, " ".join(w if w == "gap" else f"{w}x{n}" for w in t)) for i, t in enumerate(texts)]
    want = brute(docs, items)
    assert len(want) > 50
    d, i = frames(spark, docs, items)
    for words in (c.BROADCAST_WORDS, 0):
        assert {(r["doc_id"], r["item_id"]) for r in c.leaked_items(d, i, broadcast_words=words).collect()} == want


def test_stock_phrases_come_last():
    phrase = "read the passage and choose the best answer".split()
    items = {k: phrase + [f"w{k}-{i}" for i in range(30)] for k in range(20)}
    stock = set(c.shingle_hash(c.word_hash(phrase, {})).tolist())
    for item in c.sketch_items(items).values():
        assert not stock & set(item.sketch.tolist()) and len(item.sketch) < len(item.words) - 4


def test_sizes_set_the_hits():
    assert [c.class_hits(k) for k in (0, 3, 5, 6, 8)] == [1, 1, 2, 4, 15]
    long, short = [f"w{i}" for i in range(300)], [f"v{i}" for i in range(12)]
    items = c.sketch_items({1: long, 2: short})
    assert items[1].hits > items[2].hits == 1
    assert set(c.SketchIndex(items).classes) == {items[1].hits, 1}


@given(st.integers(5, 80), st.integers(1, 6), st.randoms(use_true_random=False))
def test_the_sketch_loses_no_item(n, kinds, rnd):
    # few kinds of words make repeated shingles; runs of five and more at any place, overlapping or not
    words = [f"w{i}" if kinds > 3 else f"w{rnd.randrange(kinds)}" for i in range(n)]
    item = c.sketch_items({1: words, 2: words[: n // 2]})[1]
    document = []
    while c.covered_share(words, there := c.shingles_of(document)) < 0.6:
        at = rnd.randrange(n - 4)
        document += [*words[at : at + rnd.choice([5, 5, 5, 7])], "gap"]
    met = {hash_ for hash_ in c.shingle_hash(c.word_hash(document, {})).tolist()} & set(item.sketch.tolist())
    assert there and len(met) >= item.hits
