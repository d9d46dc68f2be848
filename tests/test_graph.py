"""File graph, entities, retrieval, walks and places against plain Python."""

import math
import random
from collections import Counter, defaultdict, deque
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loamgraph.operators import detail, entities, filegraph, fusion, graph, layout, lexical, vectors
from loamgraph.operators.ranking import with_position

EDGE = "src string, dst string, rel string, weight bigint"


def test_census(spark):
    names = ["note.md", "paper.pdf", "fig.png", "main.ts", "skip.bin", "node_modules/dep.md"]
    row = filegraph.census(spark.createDataFrame([(n,) for n in names], "path string")).first()
    assert (row["markdown"], row["pdf"], row["image"], row["code"], row["skipped"], row["office"]) == (1, 1, 1, 1, 1, 0)
    assert row["samples"] == sorted(["note.md", "paper.pdf", "fig.png", "main.ts"])


def test_imports_resolve_in_order(spark):
    files = spark.createDataFrame([("d/a.ts", ""), ("d/b.ts", ""), ("d/b.tsx", ""), ("d/c.md", ""), ("c.md", "")], "path string, text string")
    specs = [("d/a.ts", s) for s in ("./b", "././b", "c", "c.md", "../c.md", "https://x", "@x/b", "crate:b", "./", "a.ts", "node_modules/b", "mailto:b")] + [("c.md", "d/c")]
    found = filegraph.resolve(spark.createDataFrame(specs, "src string, spec string"), files)
    assert Counter((r["src"], r["dst"]) for r in found.collect()) == {("d/a.ts", "d/b.ts"): 2, ("d/a.ts", "d/c.md"): 2, ("c.md", "d/c.md"): 1}


def test_siblings_form_rings(spark):
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "d/x", "d/y", "d/z", "e/only")], "id string")
    assert {(r["src"], r["dst"]) for r in filegraph.sibling_edges(nodes).collect()} == {("a", "b"), ("d/x", "d/y"), ("d/y", "d/z"), ("d/z", "d/x")}


def test_chunks_are_grafted(spark):
    nodes = spark.createDataFrame([("a.pdf", "pdf", "a.pdf"), ("a.pdf#1", "chunk", "old")], "id string, kind string, label string")
    chunks = spark.createDataFrame([("a.pdf", 0, "x"), ("a.pdf", 3, "y"), ("a.pdf", 1, "z"), ("gone.md", 0, "q")], "path string, chunk_index int, content string")
    grown, edges = filegraph.graft_chunks(nodes, spark.createDataFrame([], EDGE), chunks)
    assert {r["id"]: r["label"] for r in grown.collect()} == {"a.pdf": "a.pdf", "a.pdf#1": "old", "a.pdf#0": "a#0", "a.pdf#3": "a#3", "gone.md#0": "gone#0"}
    assert {(r["src"], r["dst"], r["rel"]) for r in edges.collect()} == {("a.pdf", f"a.pdf#{i}", "contains") for i in (0, 1, 3)} | {("a.pdf#0", "a.pdf#1", "next"), ("a.pdf#1", "a.pdf#3", "next")}


def test_withheld_entities_are_hidden(spark):
    nodes = spark.createDataFrame([("f", "text", "f")], "id string, kind string, label string")
    ents = spark.createDataFrame([("e1", "concept", "One", False), ("e2", "concept", "Two", True)], "id string, kind string, name string, withheld boolean")
    edges = spark.createDataFrame([("e1", "f", "mentions", 1), ("e1", "e2", "relates_to", 1)], EDGE)
    grown, kept = filegraph.graft_entities(nodes, spark.createDataFrame([], EDGE), ents, edges)
    assert {r["id"] for r in grown.collect()} == {"f", "e1"} and [tuple(r)[:2] for r in kept.collect()] == [("e1", "f")]


def test_caps(spark):
    chunks = spark.createDataFrame([(p, i) for p in "ab" for i in range(5)], "path string, chunk_index int")
    assert [tuple(r) for r in filegraph.capped_chunks(chunks, 3, 4).orderBy("path", "chunk_index").collect()] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_linking(spark):
    docs = [("a.md", 0, "Claude Shannon wrote on Information Theory. Claude Shannon again."), ("b.md", 0, "Claude Shannon and Information Theory."), ("c.md", 0, "")]
    linked = entities.link(spark.createDataFrame(docs, "path string, chunk_index int, content string"))
    ents = {r["id"]: r for r in linked.entities.collect()}
    shannon = ents["entity:claude-shannon"]
    assert shannon["name"] == "Claude Shannon" and shannon["mentions"] == 3 and shannon["files"] == ["a.md", "b.md"] and shannon["merges"] == []
    assert [(s["path"], s["count"]) for s in shannon["sightings"]] == [("a.md", 2), ("b.md", 1)]
    edges = {(r["src"], r["dst"], r["rel"]): r["weight"] for r in linked.edges.collect()}
    assert edges["entity:claude-shannon", "entity:information-theory", "relates_to"] == 2 and edges["entity:claude-shannon", "a.md", "mentions"] == 2
    stats = linked.stats.first()
    assert (stats["entities"], stats["cross_file"], stats["relates_to"], stats["withheld"]) == (2, 2, 1, 0)
    assert entities.link(spark.createDataFrame([], "path string, chunk_index int, content string")).entities.count() == 0


def test_names_and_merge_notes(spark):
    found = spark.createDataFrame([("bell-labs", "Bell Labs", "a", 0, 3), ("bell-labs", "BELL LABS", "a", 1, 1), ("bell-labs", "Bell-Labs", "b", 0, 1)], "slug string, surface string, path string, chunk_index int, n bigint")
    row = entities.names(found, entities.ranked(found)).first()
    assert row["name"] == "Bell Labs" and row["aliases"] == ["BELL LABS", "Bell-Labs"] and row["merges"][0]["surfaces"] == ["Bell Labs", "BELL LABS", "Bell-Labs"]


def test_near_pairs_and_conflicts(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], 5), ("b", [0.99, 0.01], 4), ("c", [0.0, 1.0], 9)], "id string, vector array<float>, mentions bigint")
    edges = entities.conflict_edges(rows, rows)
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "conflicts_with", 100)]


def test_nearest_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = rnd.normal(size=(300, 8)).astype(np.float32)
    rows[17] = rows[3]
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>").repartition(5)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit.astype(np.float64) @ unit.T
    for r in vectors.nearest(frame.where("vec_id % 20 = 0"), frame, 4).collect():
        others = sorted((i for i in range(300) if i != r["query"]), key=lambda i: (-near[r["query"], i], i))
        assert abs(near[r["query"], others[r["rank"] - 1]] - r["score"]) < 1e-6
    assert vectors.nearest(frame.limit(0), frame, 4).count() == 0
    top = [r["vec_id"] for r in vectors.top_k(frame, [float(x) for x in rows[3]], 2).collect()]
    assert top == [3, 17]


def bm25(docs, query):
    tokens = {k: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in d.lower()).split() if len(w) > 2] for k, d in docs.items()}
    n, mean = len(docs), max(1.0, sum(map(len, tokens.values())) / len(docs))
    out = {}
    for k, words in tokens.items():
        score = 0.0
        for term in (w for w in query.lower().split() if len(w) > 2):
            tf, df = words.count(term), sum(term in x for x in tokens.values())
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if score > 0:
            out[k] = score
    return out


def test_bm25(spark):
    docs = {("a.md", 0): "Crystals form a lattice; crystals grow.", ("b.md", 0): "Potatoes grow underground", ("c.md", 0): "", ("d.md", 1): "lattice lattice lattice of it"}
    frame = spark.createDataFrame([(*k, v) for k, v in docs.items()], "path string, chunk_index int, content string")
    for query in ("crystals lattice", "grow grow lattice", "nothing here", ""):
        found = {(r["path"], r["chunk_index"]): r["score"] for r in lexical.bm25(frame, query, 10).collect()}
        want = bm25(docs, query)
        assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert lexical.bm25(frame.limit(0), "lattice").count() == 0


def test_fusion(spark):
    lists = spark.createDataFrame([("only", 0, 1.0, "p", "vector", 0, 1), ("both", 0, 0.9, "v", "vector", 0, 2), ("words", 0, 5.0, "p", "lexical", 1, 1), ("both", 0, 4.0, "l", "lexical", 1, 2)], "path string, chunk_index int, score double, preview string, list string, number int, `rank` int")
    rows = fusion.fuse(lists, 10).collect()
    assert [r["path"] for r in rows] == ["both", "only", "words"]
    assert abs(rows[0]["rrf_score"] - 2 / 62) < 1e-12 and rows[0]["score"] == 0.9 and rows[0]["preview"] == "v" and rows[0]["lists"] == ["vector", "lexical"]
    assert abs(rows[1]["rrf_score"] - 1 / 61) < 1e-12


def test_expansion_reaches_other_files(spark):
    chunks = spark.createDataFrame([("a.md", 0, "x"), ("b.md", 0, "y"), ("b.md", 1, "z")], "path string, chunk_index int, content string")
    ents = spark.createDataFrame([("s", 4, ["a.md"], False), ("l", 3, ["b.md"], True)], "id string, mentions bigint, files array<string>, withheld boolean")
    edges = spark.createDataFrame([("l", "s", "relates_to", 12), ("s", "l", "mentions", 99)], EDGE)
    hits = chunks.where("path = 'a.md'").select("path", "chunk_index")
    found = fusion.expand(hits, ents, edges, chunks, chunks.where("chunk_index = 1").select("path", "chunk_index"), 5)
    assert [(r["path"], r["chunk_index"], r["score"]) for r in found.collect()] == [("b.md", 0, 12.0)]


def made(seed, n=40, m=70):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    return ids, [(rnd.choice(ids[:-3]), rnd.choice(ids[:-3]), "relates_to", 1) for _ in range(m)]


def distances(edges, focus):
    near = defaultdict(set)
    for a, b, *_ in edges:
        near[a].add(b)
        near[b].add(a)
    seen, queue = {focus: 0}, deque([focus])
    while queue:
        v = queue.popleft()
        for w in near[v]:
            if w not in seen:
                seen[w] = seen[v] + 1
                queue.append(w)
    return seen, near


def test_walks(spark):
    ids, edges = made(2)
    frame = spark.createDataFrame([*edges, ("n0", "n0", "x", 1), (None, "n1", "x", 1)], EDGE)
    seen, near = distances([*edges, ("n0", "n0")], "n0")
    assert {r["id"] for r in graph.hop(frame, "n0").collect()} == near["n0"]
    for depth in (1, 2, 4):
        assert {r["id"]: r["distance"] for r in graph.blast(frame, "n0", depth).collect()} == {k: d for k, d in seen.items() if 0 < d <= depth}
    assert graph.hop(frame, "nobody").count() == graph.blast(frame, "nobody").count() == 0


def centrality(ids, edges):
    out = dict.fromkeys(ids, 0.0)
    walks = {s: distances(edges, s) for s in ids}

    def paths(s, t):
        if s == t:
            return [[t]]
        seen, near = walks[s]
        return [p + [t] for w in near[t] if seen.get(w, -9) == seen[t] - 1 for p in paths(s, w)]

    for s, t in combinations(ids, 2):
        if t in walks[s][0]:
            every = paths(s, t)
            for p in every:
                for v in p[1:-1]:
                    out[v] += 2 / len(every)
    n = len(ids)
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_both_ways(spark):
    ids, edges = made(7, 25, 40)
    want = centrality(ids, edges)
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    frame = spark.createDataFrame([*edges, *edges[:5], ("n1", "n1", "x", 1), ("n1", "unknown", "x", 1)], EDGE)
    for bound in (1000, 0):
        found = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, frame, broadcast_edges=bound).collect()}
        assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert [r["betweenness"] for r in graph.betweenness(nodes.limit(2), frame).collect()] == [0.0, 0.0]


def test_betweenness_of_many_edges_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(graph, "betweenness_by_joins", None)
    clique = spark.range(1100).select(F.format_string("n%04d", "id").alias("src"))
    pairs = clique.join(clique.withColumnRenamed("src", "dst")).where("src < dst").select("src", "dst", F.lit("x").alias("rel"), F.lit(1).alias("weight"))
    frame = pairs.unionByName(spark.createDataFrame([("n0000", "tail", "x", 1), ("end", "tail", "x", 1)], EDGE))
    nodes = clique.withColumnRenamed("src", "id").unionByName(spark.createDataFrame([("tail",), ("end",), ("alone",)], "id string"))
    found = {r["id"]: r["betweenness"] * 1102 * 1101 for r in graph.betweenness(nodes, frame).collect()}
    assert len(found) == 1103 and abs(found["n0000"] - 2 * 2 * 1099) < 1e-6 and abs(found["tail"] - 2 * 1100) < 1e-6
    assert {v for k, v in found.items() if k not in ("n0000", "tail")} == {0.0}


def test_betweenness_of_twins_and_of_pieces(spark):
    edges = [(f"a{i}", f"a{j}", "x", 1) for i in range(4) for j in range(i)] + [(f"a{i}", f"b{j}", "x", 1) for i in (0, 1) for j in range(3)]
    edges += [("b0", "c", "x", 1), ("b1", "c", "x", 1), ("c", "d", "x", 1), ("p", "q", "x", 1), ("q", "r", "x", 1), ("s", "t", "x", 1)]
    ids = sorted({x for e in edges for x in e[:2]} | {"alone"})
    want = centrality(ids, edges)
    nodes, frame = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, EDGE)
    for bound in (1000, 0):
        found = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, frame, broadcast_edges=bound).collect()}
        assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_betweenness_by_joins_writes_a_turn_at_a_time(spark, monkeypatch):
    ids, edges = made(11, 24, 60)
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    pairs = spark.createDataFrame(sorted({tuple(sorted(e[:2])) for e in edges if e[0] != e[1]}), "a string, b string")
    written, keep = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label, *a: (written.append((label, (kept := keep(df, label, *a)).count())), kept)[1])
    want = centrality(ids, edges)
    found = {r["id"]: r["betweenness"] for r in graph.betweenness_by_joins(nodes, pairs, joined_rows=200).collect()}
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert max(n for _, n in written) <= 200


def test_betweenness_in_pieces(spark, monkeypatch):
    ids, edges = made(13, 300, 900)
    nodes, frame = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, EDGE)
    monkeypatch.setattr(graph, "PIECE", 50)
    monkeypatch.setattr(graph, "WIDE_EDGES", 0)
    want = centrality(ids, edges)
    found = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, frame).collect()}
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_cards(spark):
    chunks = spark.createDataFrame([("a.md", i, "c" * 300) for i in range(8)], "path string, chunk_index int, content string")
    assert detail.node_passages(chunks, "a.md").count() == 6 and detail.node_passages(chunks, "a.md#3").first()["chunk_index"] == 3
    assert detail.node_passages(chunks, "a.md#x").count() == 0 and len(detail.node_passages(chunks, "a.md#3").first()["excerpt"]) == 280
    ents = spark.createDataFrame([("e", "Name", ["a.md"], [("a.md", 1, "s", 1), ("gone", 0, "s", 1)])], "id string, name string, files array<string>, sightings array<struct<path:string,chunk_index:int,surface:string,cnt:bigint>>")
    assert {r["path"]: len(r["excerpt"]) for r in detail.entity_passages(ents, chunks, "e").collect()} == {"a.md": 280, "gone": 0}
    nodes = spark.createDataFrame([("f", "label")], "id string, label string")
    edges = spark.createDataFrame([("e", "f", "mentions", None), ("x", "e", "relates_to", 2)], EDGE)
    assert {(r["id"], r["label"], r["weight"]) for r in detail.neighbours(edges, nodes, ents, "e").collect()} == {("f", "label", 1), ("x", "x", 2)}


def test_positions(spark):
    rows = spark.createDataFrame([(f"{i:04d}",) for i in random.Random(1).sample(range(2000), 700)], "id string").repartition(6)
    found = [(r["id"], r["position"]) for r in with_position(rows, ["id"]).orderBy("id").collect()]
    assert [p for _, p in found] == list(range(700))


def test_places(spark):
    nodes = spark.createDataFrame([(f"f{i}",) for i in range(5)], "id string")
    for r in layout.place_files(nodes).collect():
        assert abs(math.hypot(r["x"], r["y"], r["z"]) - 110) < 1e-9
    start = pd.DataFrame({"id": ["a", "b", "c"], "degree": [1, 1, 0], "x": [1.0, 2.0, 3.0], "y": [0.0] * 3, "z": [0.0] * 3})
    out = layout.relax(start, np.array([[0, 1]]))
    assert np.isfinite(out).all() and np.linalg.norm(out, axis=1).max() <= 480 + 1e-9
    edges = spark.createDataFrame([("a", x, "r", 1) for x in "bcdefgh"], EDGE)
    assert {(r["b"], r["c"]) for r in layout.membranes(edges).where("id = 'a'").collect()} == {("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "b")}
    assert layout.linlog(spark.createDataFrame([("a",), ("b",)], "id string"), edges).count() == 2
    assert abs(spark.range(1).select(layout.tube_radius(F.lit("x"), F.lit(1))).first()[0] - (0.12 + math.log(2) * 0.16)) < 1e-12


def relaxed(start, springs, k=1.0):
    at, speed, weight = start[["x", "y", "z"]].to_numpy(), np.zeros((len(start), 3)), np.log2(start["degree"].to_numpy() + 1)
    rounds = min(48, 16 + math.ceil(len(start) / 8))
    for r in range(rounds):
        cool = 1 - r / rounds
        away = at[:, None] - at[None]
        square = (away**2).sum(axis=2) + 1
        speed += (away * (420 * cool / square**1.5 * (1 + (weight[:, None] + weight[None]) * k))[:, :, None]).sum(axis=1)
        for a, b in springs:
            along = at[b] - at[a]
            length = np.linalg.norm(along) + 0.1
            pull = along / length * 0.035 * (length - (26 + k * 7)) * cool
            speed[a] += pull
            speed[b] -= pull
        speed *= 0.82
        speed *= np.minimum(1, 22 / np.maximum(np.linalg.norm(speed, axis=1), 1e-12))[:, None]
        at = at + speed
        at = at * np.minimum(1, 480 / np.maximum(np.linalg.norm(at, axis=1), 1e-12))[:, None]
    return at


def test_forces_in_one_task_and_in_many(spark):
    rng = random.Random(5)
    ids = [f"n{i:03d}" for i in range(300)]
    edges = [(*rng.sample(ids, 2), "x", 1) for _ in range(500)]
    edges += [*edges[:9], ("n001", "n001", "x", 1), ("n002", "unknown", "x", 1)]
    nodes, frame = spark.createDataFrame([(x,) for x in ids], "id string").repartition(3), spark.createDataFrame(edges, EDGE)
    start = layout.place_entities(nodes, frame, 2.0).toPandas().sort_values("id", ignore_index=True)
    want = relaxed(start, [(ids.index(a), ids.index(b)) for a, b, *_ in edges if b != "unknown"], 2.0)
    for most in (1000, 0):
        found = layout.linlog(nodes, frame, 2.0, one_task=most).toPandas().sort_values("id", ignore_index=True)
        assert list(found["id"]) == ids and np.abs(found[["x", "y", "z"]].to_numpy() - want).max() < 1e-5
    few = layout.linlog(nodes.where("id < 'n003'"), frame, one_task=0)
    assert few.count() == 3 and layout.linlog(nodes.limit(0), frame, one_task=0).count() == 0


def test_repulsion_by_cells_is_that_of_all_pairs():
    from loamgraph.operators import repulsion

    rng = np.random.default_rng(4)
    on = rng.normal(size=(4000, 3))
    on *= 480 / np.linalg.norm(on, axis=1)[:, None]
    for at in (on, on * rng.random((4000, 1)), np.concatenate([on[:1000] / 40 + 300 / 1.8, on[:1000], on[:3]])):
        at = at * np.minimum(1, 480 / np.linalg.norm(at, axis=1))[:, None]
        weight = rng.random(len(at)) * 9
        near = np.array([[((at[i] - at) * (f / (1 + ((at[i] - at) ** 2).sum(axis=1)) ** 1.5)[:, None]).sum(axis=0) for f in (1, weight)] for i in range(0, len(at), 97)])
        for level in (1, 2, 3, 4):
            cells = len(repulsion.cells_of(at, 480, level)[1])
            found = np.full((len(at), 2, 3), np.nan)
            for low, high in ((0, cells // 3), (cells // 3, cells // 3), (cells // 3, cells)):
                rows, part = repulsion.fields(at, weight, 480, level, low, high)
                found[rows] = part
            wrong = np.linalg.norm(found[::97] - near, axis=2) / np.linalg.norm(near, axis=2)
            assert wrong.max() < (1e-9 if level == 1 else 1e-4) and np.median(wrong) < 1e-6
        level, parts = repulsion.plan(at, 480, 5)
        assert parts[0][0] == 0 and parts[-1][1] == len(repulsion.cells_of(at, 480, level)[1]) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_pairs_met_one_by_one_do_not_grow_with_their_square():
    from loamgraph.operators import repulsion

    met = []
    for n in (100_000, 400_000):
        at = np.random.default_rng(6).normal(size=(n, 3))
        at *= 480 / np.linalg.norm(at, axis=1)[:, None]
        _, cells, begin = repulsion.cells_of(at, 480, repulsion.plan(at, 480, 6)[0])
        met.append(float((np.diff(begin).astype(float) ** 2).sum() * 9))
    assert met[1] < n * n / 20 and met[1] < 10 * met[0]


def test_pairs_of_groups_of_any_size(spark):
    from loamgraph.operators.pairs import pair_counts

    groups = {1: {f"i{n:03d}" for n in range(90)}, 2: {"i001", "i002", "x"}, 3: {"x"}, 4: set()}
    rows = spark.createDataFrame([(g, i) for g, items in groups.items() for i in items], "g int, item string")
    want = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    for split_at in (64, 20, 2):
        assert {(r["a"], r["b"]): r["n"] for r in pair_counts(rows, ["g"], "item", split_at).collect()} == want
    assert pair_counts(rows.limit(0), ["g"], "item").count() == 0


def test_indexes_of_several_parts_are_one_corpus(spark, tmp_path):
    rows = [("a", i, f"alpha beta {'gamma ' * (i % 3)}word{i}") for i in range(9)]
    both = spark.createDataFrame([(f"p/{p}", i, t) for p, i, t in rows] + [(f"q/{p}", i + 20, t + " alpha") for p, i, t in rows], "path string, chunk_index int, content string")
    whole = lexical.LexicalIndex.build(both, str(tmp_path / "whole"))
    for part in "pq":
        ours = both.where(F.col("path").startswith(part)).withColumn("path", F.substring("path", 3, 99))
        lexical.LexicalIndex.build(ours, str(tmp_path / part))
    parts = lexical.LexicalIndex.of(spark, {part: str(tmp_path / part) for part in "pq"})
    for query in ("alpha gamma", "word3 word25", "nothing here", ""):
        for limit in (5, None):
            assert [tuple(r) for r in parts.search(query, limit).collect()] == [tuple(r) for r in whole.search(query, limit).collect()]
