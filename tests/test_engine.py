"""Sources, stores, judging, asking, settings and the engine end to end."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loamgraph.api import Engine, Limits
from loamgraph.operators import asking, judging
from loamgraph.plans.settings import Endpoint, Settings
from loamgraph.sources.embedding import HashingEmbedder, embed, query_vector, with_prefix
from loamgraph.sources.files import list_files, read_folder, read_texts
from loamgraph.sources.points import Collection, make_points
from loamgraph.streaming.ingest import ingest_stream, stream_texts


@pytest.fixture()
def folder(tmp_path):
    files = {
        "alpha.md": "Claude Shannon met Information Theory at Bell Labs. See [beta](beta.md).", "beta.md": "Claude Shannon and Information Theory. " * 80, "src/a.ts": "import { x } from './b'\nconst d = '— from x';", "src/b.ts": "export const x = 1;",
        "page.html": "<p>Hi <b>Bell Labs</b></p>", "bad.txt": None, "blank.txt": "  \n", "node_modules/dep.md": "no", "x.bin": "no", "p.pdf": "%PDF", "~$tmp.doc": "no",
    }
    for name, text in files.items():
        path = tmp_path / "lab" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\xff\xfe\xfa" if text is None else text.encode())
    return str(tmp_path / "lab")


def test_listing(folder):
    found, cut = list_files(folder)
    assert "src/a.ts" in found and "node_modules/dep.md" not in found and "~$tmp.doc" not in found and not cut
    assert list_files(folder, 2) == (found[:2], True)


def test_reading(spark, folder):
    texts, skipped = read_texts(read_folder(spark, folder))
    assert {r["path"]: r["text"] for r in texts.collect()}["page.html"] == "Hi Bell Labs"
    assert {r["path"]: r["reason"] for r in skipped.collect()} == {"bad.txt": "not valid UTF-8", "blank.txt": "blank.txt: empty", "p.pdf": "pdf: no extractor"}
    texts, skipped = read_texts(read_folder(spark, folder), lambda raw: raw.decode() + " read")
    assert {r["path"]: r["text"] for r in texts.collect()}["p.pdf"] == "%PDF read"


def test_engine(spark, folder, tmp_path):
    engine = Engine(spark, str(tmp_path / "home"), limits=Limits(None, None, None), progress=(said := []).append)
    report = engine.ingest(folder)
    assert report.named and not report.truncated and len(said) == 3
    assert report.files == 5 and engine.scan(folder)[1].where("kind = 'chunk'").count() == engine.table("chunks").count() and report.stats.first()["entities"] >= 2
    edges = {(r["src"], r["dst"], r["rel"]) for r in engine.table("edges").collect()}
    assert ("src/a.ts", "src/b.ts", "imports") in edges and ("alpha.md", "beta.md", "imports") in edges and ("entity:claude-shannon", "entity:information-theory", "relates_to") in edges
    assert "src/b.ts" in {r["id"] for r in engine.hop("src/a.ts").collect()} and engine.blast("alpha.md").count() > 2
    found = engine.retrieve("Shannon information")
    assert found.hits.first()["path"] in ("alpha.md", "beta.md") and found.summary.first()["via_lexical"] > 0
    card = engine.node_detail("entity:claude-shannon")
    assert card["node"].first()["degree"] >= 1 and card["passages"].count() >= 2 and engine.node_detail("alpha.md")["passages"].count() == 1
    assert engine.entity_detail("entity:claude-shannon")["chunks"].count() >= 2
    with pytest.raises(ValueError):
        engine.entity_detail("entity:nobody")
    assert engine.status()["ready"] and engine.status()["points"] == engine.table("chunks").count()
    engine.rebuild_entities(lambda prompt: "\n".join("DROP" for _ in prompt.splitlines()[1:]))
    assert engine.table("entities").where("NOT withheld").count() == 0 and not engine.table("nodes").where("id LIKE 'entity:%'").count()


def test_collection(spark, tmp_path):
    store = Collection(spark, str(tmp_path / "points"), 2).ensure()
    rows = lambda folder, text, n: make_points(spark.createDataFrame([("a", i, text, [1.0, float(i)]) for i in range(n)], "path string, chunk_index int, content string, vector array<float>"), folder)
    store.replace_folder(rows("x y/z", "old", 3))
    store.replace_folder(rows("w", "old", 2))
    store.upsert(rows("w", "new", 1))
    assert sorted((r["folder"], r["content"]) for r in store.read().collect()) == [("w", "new"), ("w", "old")] + [("x y/z", "old")] * 3
    assert [tuple(r) for r in store.scroll("x y/z", 2).collect()] == [("a", 0), ("a", 1)]
    store.delete_folder("x y/z")
    assert store.count() == 2
    with pytest.raises(Exception, match="expected 2 numbers"):
        store.replace_folder(rows("v", "t", 1).withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    assert store.count() == 2


def test_streaming_ingest(spark, tmp_path):
    store, embedder = Collection(spark, str(tmp_path / "points"), 16).ensure(), HashingEmbedder(16)
    for i, text in enumerate(("first", "second")):
        spark.createDataFrame([(f"{i}.md", text), ("same.md", text)], "path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_stream(stream_texts(spark, str(tmp_path / "in")), store, embedder, "live", str(tmp_path / "state")).awaitTermination()
    assert {r["rel_path"]: r["content"] for r in store.read().collect()} == {"0.md": "first", "1.md": "second", "same.md": "second"}


@pytest.mark.parametrize(("most", "cut"), [(None, False), (420, True)])
def test_long_texts_are_taken_whole(spark, tmp_path, most, cut):
    texts = spark.createDataFrame([("long.md", "\n".join(f"line {i} of a long text without names" for i in range(20_000)) + "\nthe very end")], "path string, text string")
    engine = Engine(spark, str(tmp_path / "home"), HashingEmbedder(8), limits=Limits(None, most, None))
    report = engine.ingest_table(texts, "long")
    assert report.truncated is cut and (report.chunks == 420 if cut else report.chunks > 420)
    assert bool(engine.table("chunks").where("content LIKE '%the very end'").count()) is not cut


def test_a_stream_takes_long_texts_whole(spark, tmp_path):
    text = "\n".join(f"line {i} of a long text without names" for i in range(20_000)) + "\nthe very end"
    spark.createDataFrame([("long.md", text)], "path string, text string").write.parquet(str(tmp_path / "in"))
    counts = []
    for most in (None, 420):
        store = Collection(spark, str(tmp_path / f"points{most}"), 8).ensure()
        ingest_stream(stream_texts(spark, str(tmp_path / "in")), store, HashingEmbedder(8), "live", str(tmp_path / f"state{most}"), chunks_per_file=most).awaitTermination()
        counts.append((store.count() > 420, store.read().where("content LIKE '%the very end'").count()))
    assert counts == [(True, 1), (False, 0)]


def test_folders_are_kept_apart(spark, tmp_path):
    rows = lambda **texts: spark.createDataFrame([(f"{k}.md", t) for k, t in texts.items()], "path string, text string")
    said = []
    engine = Engine(spark, str(tmp_path / "home"), HashingEmbedder(16), settings_folder=str(tmp_path / "set"), client=lambda e: lambda prompt: said.append(prompt) or "\n".join("DROP" for _ in prompt.splitlines()[1:]) or "ready")
    engine.ingest_table(rows(a1="Claude Shannon wrote of entropy. Claude Shannon again.", same="entropy of A"), "A")
    engine.ingest_table(rows(b1="Claude Shannon wrote of entropy in B. Claude Shannon.", b2="entropy", same="entropy of B"), "B")
    assert engine.store.folders() == ["A", "B"] and engine.status()["ready"] and engine.status()["error"] is None
    paths = lambda **how: {r["path"] for r in engine.retrieve("entropy Shannon", **how).hits.collect()}
    assert paths(folder="A") == {"a1.md", "same.md"} and paths(folder="B") == {"b1.md", "b2.md", "same.md"}
    assert paths() == {"A/a1.md", "A/same.md", "B/b1.md", "B/b2.md", "B/same.md"}
    assert {r["path"] for r in engine.table("chunks").collect()} == {"b1.md", "b2.md", "same.md"} and engine.table("chunks", "A").count() == 2
    again = Engine(spark, str(tmp_path / "home"), HashingEmbedder(16))
    assert again.table("chunks", "A").count() == 2 and again.hop("a1.md", "A").count() >= 1
    with pytest.raises(ValueError, match="name a folder"):
        again.table("chunks")
    card = engine.node_detail("same.md", "A", engine.retrieve("entropy", "A").hits)
    assert card["node"].first()["degree"] == engine.hop("same.md", "A").count() and card["passages"].first()["rrf_score"] > 0
    assert engine.node_detail("entity:claude-shannon", "A")["files"].first()["path"] == "a1.md"
    engine.save_endpoint(" http://x ", "", "m")
    assert engine.status()["endpoint"] and Settings.load(str(tmp_path / "set")).endpoint.url == "http://x" and said and not engine.table("entities").where("NOT withheld").count()
    engine.clear_endpoint()
    assert not engine.status()["endpoint"] and engine.table("entities").where("NOT withheld").count() and engine.dismiss_welcome().welcome_seen
    engine.ingest_table(rows(), "A")
    assert not engine.points.read().where("folder = 'A'").count() and engine.points.read().where("folder = 'B'").count() == 3
    engine.remove("B")
    assert engine.store.folders() == ["A"] and engine.points.count() == 0


def test_a_failed_change_leaves_the_old_tables(spark, tmp_path):
    from loamgraph.plans.store import Store

    store = Store(spark, str(tmp_path / "s"))
    store.put("f", {"t": spark.range(3)})
    with pytest.raises(Exception, match="broken"):
        store.put("f", {"t": spark.range(5), "u": spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))})
    assert store.read("t", "f").count() == 3 and store.tables() == {"t"}
    for n in range(3):
        store.put("f", {"t": spark.range(n)})
    assert store.read("t", "f").count() == 2 and len(os.listdir(tmp_path / "s" / "parts")) == 2


@pytest.mark.parametrize("name", ["lab c++ (1)", "a.b [x] {y}", "plain"])
def test_roots_of_any_name(spark, tmp_path, name):
    for file in ("__init__.py", "sub/x.md", ".hid.md"):
        path = tmp_path / name / file
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text")
    assert {r["path"] for r in read_folder(spark, str(tmp_path / name)).collect()} == {"__init__.py", "sub/x.md", ".hid.md"}


def test_a_stream_lets_files_shrink(spark, tmp_path):
    store, embedder = Collection(spark, str(tmp_path / "points"), 16).ensure(), HashingEmbedder(16)
    for text in ("line of text\n" * 1000, "short", ""):
        spark.createDataFrame([("a.md", text), ("b.md", "kept")], "path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_stream(stream_texts(spark, str(tmp_path / "in")), store, embedder, "live", str(tmp_path / "state")).awaitTermination()
    assert [(r["rel_path"], r["content"]) for r in store.read().collect()] == [("b.md", "kept")]


def test_widths_are_checked(spark):
    from loamgraph.operators.vectors import top_k

    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id bigint, embedding array<float>")
    assert top_k(points, [1.0, 0.0], 1, dims=2).count() == 1
    with pytest.raises(ValueError, match="expected 2"):
        top_k(points, [1.0], 1, dims=2)
    with pytest.raises(Exception, match="expected 3"):
        top_k(points, [1.0, 0.0, 0.0], 1, dims=3).collect()


def test_embedding(spark):
    e = HashingEmbedder(8)
    frame = embed(spark.createDataFrame([("a b",), (None,)], "t string"), "t", e)
    assert [round(x, 6) for x in frame.first()["vector"]] == [round(x, 6) for x in query_vector(e, "a b")] and frame.where("t IS NULL").first()["vector"] == [0.0] * 8
    assert with_prefix("x" * 2000, True, True) == "search_query: " + "x" * 1800 and with_prefix("y", False, False) == "y"


def test_verdicts():
    items = ["Bell Labs", "Foo", "Bar"]
    reply = "intro\nKEEP Bell Labs organization\ndrop\nKEEP KEEP Barr Person\nKEEP more"
    assert [(v.keep, v.canonical, v.kind) for v in judging.parse_verdicts(reply, items)] == [(True, "Bell Labs", "organization"), (False, "Foo", ""), (True, "Barr", "person")]
    assert judging.parse_verdicts("KEEP a", items) is None
    assert judging.parse_verdicts("KEEP place", ["X"])[0].canonical == "X" and judging.parse_verdicts("KEEP Some Name", ["X"])[0].kind == "concept"
    assert judging.build_prompt(items).splitlines()[1:] == items


def test_adjudication(spark):
    ents = spark.createDataFrame([(f"e{i}", f"Name {i:02d}", "concept", ["endpoint_rejected"] if i == 1 else [], i == 1, 100 - i) for i in range(13)], "id string, name string, kind string, flags array<string>, withheld boolean, mentions bigint")

    def complete(prompt):
        lines = prompt.splitlines()[1:]
        if "Name 12" in lines:
            return "no"
        return "\n".join("DROP" if x == "Name 00" else "KEEP Other Thing place" if x == "Name 02" else f"KEEP {x} person" for x in lines)

    found = {r["id"]: r for r in judging.adjudicate(ents, complete).collect()}
    assert found["e0"]["withheld"] and found["e0"]["flags"] == ["endpoint_rejected"]
    assert not found["e1"]["withheld"] and found["e1"]["flags"] == [] and found["e1"]["kind"] == "person"
    assert found["e2"]["flags"] == ["endpoint_disagrees:Other Thing"] and found["e2"]["kind"] == "place"
    assert found["e12"]["kind"] == "concept" and found["e12"]["flags"] == []


def test_tools(spark):
    nodes = spark.createDataFrame([("a", "text", "a"), ("b", "text", "bee"), ("c", "concept", "cee")], "id string, kind string, label string")
    edges = spark.createDataFrame([("a", "b", "relates_to", 2), ("b", "c", "relates_to", 4)], "src string, dst string, rel string, weight bigint")
    ents = spark.createDataFrame([], "id string, name string")
    assert asking.graph_tool("hop", {"focus": " a "}, nodes, edges, ents)["neighbors"] == [{"id": "b", "label": "bee"}]
    assert [n["id"] for n in asking.graph_tool("blast", {"focus": "a", "depth": 9}, nodes, edges, ents)["nodes"]] == ["b", "c"]
    with pytest.raises(ValueError, match="unknown node"):
        asking.graph_tool("hop", {"focus": "zz"}, nodes, edges, ents)
    hit = {"path": "a", "chunk_index": 0, "score": 1.0, "rrf_score": 0.5, "preview": "p"}
    call = {"id": "1", "function": {"name": "hop", "arguments": json.dumps({"focus": "a"})}}
    script = iter([{"tool_calls": [call, {"function": {"name": "fly"}}, {"function": {"name": "retrieve", "arguments": {"query": "q"}}}]}, {"content": " done "}])
    reply = asking.ask("why", lambda messages, tools: next(script), lambda q: [hit], nodes, edges, ents)
    assert asking.tools_refused("function calling is Unsupported") and not asking.tools_refused("the function failed") and asking.message_text({"content": " ", "reasoning_content": "x"}) == ""
    assert reply.answer == "done" and reply.highlight == ["a", "a#0", "b"] and [t.split()[0] for t in reply.trace] == ["hop", "fly", "retrieve"]

    def refusing(messages, tools):
        if tools:
            raise RuntimeError("this model does not support tools")
        return {"reasoning_content": "plain"}

    assert asking.ask("why", refusing, lambda q: [hit], nodes, edges, ents) == asking.Reply("plain", [], [asking.WITHOUT_TOOLS], False)
    with pytest.raises(RuntimeError, match="no answer after"):
        asking.ask("why", lambda m, t: {"tool_calls": [call]}, lambda q: [], nodes, edges, ents)
    assert asking.tool_calls({"tool_calls": [{"function": {"name": "x", "arguments": "nonsense"}}, {"function": {}}]}) == [asking.ToolCall("", "x", {})]
    assert {asking.completions_url(u) for u in ("http://h", "http://h/v1/", "http://h/v1/chat/completions")} == {"http://h/v1/chat/completions"}


def test_tools_in_sql(spark):
    from loamgraph.operators import graph
    from loamgraph.plans.sql_tools import register_tools

    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", None), ("c", None)], "id string, label string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "a"), ("b", "a"), (None, "a")], "src string, dst string")
    register_tools(spark, nodes, edges, "t")
    assert {tuple(r) for r in spark.sql("SELECT * FROM t_hop('a')").collect()} == {("a", "A"), ("b", "B")}
    for depth in (1, 2, 3):
        want = {(r["id"], r["distance"]) for r in graph.blast(edges, "a", depth).collect()}
        assert {(r["id"], r["distance"]) for r in spark.sql(f"SELECT * FROM t_blast('a', {depth})").collect()} == want


def test_settings(tmp_path):
    s = Settings(welcome_seen=True, endpoint=Endpoint("http://x", "k", "m"))
    s.save(str(tmp_path / "d"))
    assert Settings.load(str(tmp_path / "d")) == s and s.has_endpoint() and not Settings().has_endpoint()
    (tmp_path / "d" / "settings.json").write_text("{broken")
    assert Settings.load(str(tmp_path / "d")) == Settings()
    with pytest.raises(ValueError):
        s.with_ports(6333, 0)


@pytest.mark.parametrize("name", ["census_by_kind", "sibling_edges", "bm25_topk", "entity_top200", "retrieve_hybrid", "blast_depth2", "points_delete_upsert"])
def test_queries_match_their_sql(spark, name):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf}/{file}'")
    got = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda rows: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    assert plain(tuple(r[c] for c in sorted(want.columns)) for r in got.collect()) == plain(want[sorted(want.columns)].astype(object).itertuples(index=False))
