"""Problem 6: ids against the tokenizer itself, offsets, and the exact round trip."""

import unicodedata

import pyarrow.parquet as pq
import pytest

from loamgraph.llm import tokenization as t

FILE = f"{t.DEFAULT_FOLDER}/{t.DEFAULT_TOKENIZER}"
TEXTS = ["", None, " ", "Hello world's  end\r\n\tx", "<|endoftext|> is text", "naïve café — 你好 👩🏽‍🔬 ́​", "a" * 200_000, "x\U0001e5d0\U00011de0y", "\x00\x07", "n" + "o " * 40_000]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, x, "e", [1]) for i, x in enumerate(TEXTS)], "doc_id bigint, text string, lang string, ids array<int>")


def test_ids_are_the_tokenizers(rows):
    found = {r["doc_id"]: r["ids"] for r in t.encode(rows).collect()}
    tokenizer = t._tokenizer(FILE)
    assert found == {i: tokenizer.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(TEXTS)}


def test_round_trip(rows):
    assert {r["doc_id"]: r["text"] for r in t.decode(t.encode(rows)).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}


def test_offsets_cover_the_text(rows):
    for r in t.encode_with_offsets(rows).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        if text:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
            assert all(a < b and c <= b for a, b, c in zip(r["starts"], r["ends"], r["starts"][1:]))


def test_lists_cut_inside_a_character(spark):
    ids = t.PieceEncoder(FILE)(["👩"])[0].tolist()
    cut = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [*ids, None])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in t.decode(cut).collect()} == {1: "�", 2: "", 3: "👩"}


def test_empty_table(spark):
    assert t.encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_pieces_are_those_of_the_tokenizer_for_settled_characters():
    pre, split = t._tokenizer(FILE).pre_tokenizer, t._pieces()
    for c in range(0, 0x110000, 7):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or unicodedata.category(ch) == "Cn":
            continue
        text = f"a{ch}1 {ch}{ch}"
        assert split(text) == [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)], hex(c)


def test_documents_of_the_smallest_table():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    ids, ends = t.PieceEncoder(FILE)(texts)
    tokenizer = t._tokenizer(FILE)
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == (tokenizer.encode(text, add_special_tokens=False).ids if text else [])


def test_byte_table_is_whole():
    assert sorted(t.byte_table().values()) == list(range(256))
