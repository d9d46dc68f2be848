"""Scalar functions and the chunker against plain Python."""

import re
import uuid
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.functions import text as t
from loamgraph.functions.chunking import SPACES, chunk_documents, chunks_of
from loamgraph.functions.vectors import cosine


def values(spark, rows, expression, name="x"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col(name))).collect()]


def test_short_texts_are_one_chunk():
    assert chunks_of("hello") == ["hello"] and chunks_of(" \n ") == chunks_of("") == chunks_of(None) == []


def test_chunks_overlap_and_never_split_characters():
    assert [len(c) for c in chunks_of("a" * 2200)] == [1800, 600]
    for mark in ("—", "’"):
        parts = chunks_of("x" * 1799 + mark + "y" * 1800)
        assert parts[0].endswith(mark) and len(parts[0].encode()) <= 1803
    assert len(chunks_of("line\n" * 200_000, most=400)) == 400


def test_chunks_end_at_paragraphs():
    text = "a" * 1000 + "\n\n" + "b" * 500 + "\n" + "c" * 900
    assert chunks_of(text)[0] == "a" * 1000


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab\n é—𝕏", max_size=9000))
def test_chunks_cover_the_text(text):
    parts = chunks_of(text, most=None)
    assert all(p == p.strip(SPACES) and p and len(p.encode()) <= 1803 for p in parts)
    assert set("".join(parts)) >= set(text.strip(SPACES)) - set("\n ")
    at = 0
    for p in parts:
        found = text.find(p[:50], max(0, at - 900))
        assert found >= 0
        at = found


def test_chunk_documents(spark):
    frame = spark.createDataFrame([(1, "x" * 4000), (2, None), (3, "")], "doc_id bigint, text string")
    rows = [(r["doc_id"], r["chunk_index"], len(r["content"])) for r in chunk_documents(frame, "doc_id").orderBy("doc_id", "chunk_index").collect()]
    assert rows == [(1, i, len(c)) for i, c in enumerate(chunks_of("x" * 4000))]


def test_strip_html(spark):
    pages = ["<p>Hi <b>there</b></p>", "a > b <unclosed", "x<script>1 < 2</script>y", None, "no  tags"]

    def plain(page):
        out, inside = [], False
        for c in page:
            if c == "<":
                inside = True
            elif c == ">":
                inside = False
            elif not inside:
                out.append(c)
        return re.sub(f"[{SPACES}]+", " ", "".join(out)).strip(" ")

    assert values(spark, pages, t.strip_html) == [None if p is None else plain(p) for p in pages]


def test_endings_and_kinds(spark):
    names = ["a/b.MD", ".bashrc", "x.tar.gz", "dir.d/file", "A.TSX", "p.pdf", None]
    assert values(spark, names, t.ending_of) == ["md", "", "gz", "", "tsx", "pdf", None]
    assert values(spark, names, lambda c: t.kind_of(t.ending_of(c))) == ["markdown", None, None, None, "code", "pdf", None]


def test_walked(spark):
    paths = ["a.md", "node_modules/x.md", "a/.git/x", "s_files/i.png", ".hidden", "~$a.doc", "x/dist/y", "distx/y"]
    assert values(spark, paths, t.walked) == [True, False, False, False, True, False, False, True]


def test_slug_and_names(spark):
    assert values(spark, ["Claude Shannon", "  AI  ", "Ünï--x", "a" * 70], t.slug) == ["claude-shannon", "ai", "n-x", "a" * 60]
    names = ["550e8400-e29b-41d4-a716-446655440000", "III", "AI", "RAG", "Bell Labs", "“Bell  Labs”,", "Abc", "ab", "x" * 61, "12345"]
    assert values(spark, names, t.normal_name) == [None, None, None, "RAG", "Bell Labs", "Bell Labs", None, None, None, None]


def test_candidates(spark):
    texts = ["Claude Shannon defined Information Theory at Bell Labs.", "Chapter III and PROP MSS appear often.", "The Big Idea", "Bank of England", "Bank of  England", None]
    found = values(spark, texts, lambda c: F.array_sort(t.candidates_of(c)))
    assert found[0] == ["Bell Labs", "Claude Shannon", "Information Theory"] and found[1] == [] and found[2] == []
    assert found[3] == [] and found[4] == ["Bank of England"] and found[5] is None


def test_point_ids(spark):
    keys = ["note.md#0", "x", ""]
    want = [str(uuid.UUID(bytes=sha256(k.encode()).digest()[:16], version=4)) for k in keys]
    assert values(spark, keys, t.point_id) == want


def test_specs(spark):
    source = "import { x } from './b'\nconst y = require(\"../c\");import 'd'; from 'a from \"z\"'"
    assert sorted(values(spark, [source], t.quoted_specs)[0]) == sorted(["./b", "../c", "d", "a from \"z\"", "z"])
    assert values(spark, ["mod  foo ; mod bar{ pub mod q;"], t.module_specs) == [["foo.rs", "q.rs"]]
    assert values(spark, ["[a]( x.md \"t\") ![b](y.png) [c]() [d](open"], t.link_specs) == [["x.md", "y.png"]]


def test_chunk_ids(spark):
    ids = ["a/b.md#12", "a#b", "plain", "x#1#2"]
    assert values(spark, ids, t.chunk_path) == ["a/b.md", None, None, "x#1"]
    assert values(spark, ids, t.chunk_number) == [12, None, None, 2]


def test_cosine(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 9.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    found = [r[0] for r in frame.select(cosine(F.col("a"), F.slice("b", 1, 2))).collect()]
    assert found[0] == 1.0 and found[1] == 0.0 and abs(found[2] - 0.5**0.5) < 1e-9
