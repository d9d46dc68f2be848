"""Problems 2, 5 and 8 on small fixtures."""

import random

import numpy as np

from loamgraph.llm import components, name_variants as nv, reading_level as rl, source_files as sf

ENTITIES = "id string, name string, kind string, component string, reading string, n bigint"


def entities(spark, names):
    given = ["Robert", "Rosa", "Maria", "Marta", "Daniel", "Dmitri"]
    crowd = [(f"c{i}-{g}", f"{g} Quol{'abcdefghij'[i]}vertin{'xyzuvwmnop'[i]}", "person") for i in range(8) for g in given]
    rows = [(i, n, k, "x", "y", 1) for i, n, k in crowd] + [(i, n, k, "x", "y", 2) for i, n, k in names]
    return spark.createDataFrame(rows, ENTITIES), {i for i, _, _ in names}


def linked(spark, names):
    frame, ours = entities(spark, names)
    return {(r["entity_a"], r["entity_b"]) for r in nv.variant_pairs(frame).collect() if {r["entity_a"], r["entity_b"]} & ours}


def test_variants_of_a_person(spark):
    names = [("a1", "Robert Zemikisal", "person"), ("a2", "Zemikisal, Bob", "person"), ("a3", "R. Zemikisal", "concept"), ("a4", "Robert Zemik1sal", None), ("a5", "Dr. Robert Q. Zemiksial", "person"), ("a6", "rzemikisal", "person"), ("a7", "RobertZemikisal", "person"), ("b1", "Maria Zemikisal", "person"), ("b2", "Marta Zemikisal", "person"), ("b3", "M. Zemikisal", "person"), ("c1", None, "person"), ("c2", " ", None), ("c3", "Hidden Bridge", "place"), ("a1", "Robert Zemikisal", "person")]
    ids = [f"a{i}" for i in range(1, 8)]
    assert linked(spark, names) == {(a, b) for a in ids for b in ids if a < b}


def test_variants_of_an_organisation(spark):
    names = [("a1", "Brofiwutor Society of Graph Methods", "organization"), ("a2", "The Brofiwutor Soc. of Graph Methods", "organization"), ("a3", "Brofiwutor SGM", "organization"), ("a4", "Society of Graph Methods, Brofiwutor", "concept"), ("a5", "Brofiwutro Society of Graph Methods e.V.", "organization"), ("b1", "Brofiwutor Society of Cold Storage", "organization"), ("b2", "Brofiwutor Laboratory 3", "organization"), ("b3", "Brofiwutor Laboratory 7", "organization"), ("b4", "Brofiwutor Lab 3", "organization"), ("c1", "DC Brofiwutor", "concept"), ("c2", "Brofiwutor & Drumicelin Company", "organization"), ("c3", "Daniel C. Brofiwutor", "person")]
    ids = [f"a{i}" for i in range(1, 6)]
    assert linked(spark, names) == {(a, b) for a in ids for b in ids if a < b} | {("b2", "b4"), ("c1", "c2")}


def test_no_entities(spark):
    assert nv.variant_pairs(spark.createDataFrame([], ENTITIES)).count() == 0


def met(spark, readings):
    return {tuple(r) for r in nv.candidate_pairs(spark.createDataFrame([(r,) for r in readings], "reading string")).collect()}


def test_blocks_hold_all_that_are_related(spark):
    given = nv.Names(frozenset(["robert", "rosa", "maria", "marta"]))
    rnd = random.Random(8)
    bases = ["Robert Zemikisal", "Rosa Zemikisal", "Maria Brofiwutor", "Marta Q. Brofiwutor", "R. Zemikisal", "M. Q. Brofiwutor", "rzemikisal", "Plato", "Sappho", "World Bank", "Deutsche Bank", "Acme Widgets", "Ministry of Health", "Harlow SMD", "Harlow Society of Marine Data", "山田 太郎", "株式会社日立製作所"]
    names = set(bases)
    for base in bases:
        for _ in range(12):
            i = rnd.randrange(len(base) - 1)
            names.add(rnd.choice([base[:i] + base[i + 1 :], base[:i] + base[i + 1] + base[i] + base[i + 2 :], base[:i] + "e" + base[i:]]))
    readings = sorted({r for n in names for kind in ("person", "organization") for r in given.read(n, kind)})
    want = {(a, b) for a in readings for b in readings if a < b and nv.relation(a, b)}
    assert len(want) > 300 and want <= met(spark, readings)


def test_names_without_words_of_organisations_and_of_one_word(spark):
    names = [("a1", "Siemens", "organization"), ("a2", "Siemens AG", "organization"), ("a3", "Seimens", "organization"), ("b1", "Acme Widgets", "organization"), ("b2", "Acme Wigdets Ltd.", None), ("c1", "General Electric", "organization"), ("c2", "Electric, General", "organization"), ("d1", "Deutsche Bank", "organization"), ("d2", "Deutshce Bank", "organization"), ("e1", "World Bank", "organization"), ("f1", "Ministry of Health", "organization"), ("f2", "Health Ministry", "organization"), ("g1", "Platon", "person"), ("g2", "Plato", "person"), ("g3", "Plotin", "person"), ("h1", "山田太郎", "person"), ("h2", "山田 太郎", None), ("h3", "山田花子", "person"), ("i1", "株式会社日立製作所", "organization"), ("i2", "日立製作所", "organization"), ("j1", "Plato", "concept"), ("k1", "Kernel", "technology")]
    assert linked(spark, names) == {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("b1", "b2"), ("c1", "c2"), ("d1", "d2"), ("f1", "f2"), ("g1", "g2"), ("h1", "h2"), ("i1", "i2")}


def test_a_frequent_surname_adds_no_pairs_of_others(spark):
    readings = [f"p|smith|{g}||full" for g in ("robert", "rosa", "richard", "rupert", "ralph")] + ["p|smiht|rosa||full", "p|smith|r.||weak"]
    assert met(spark, readings) == {("p|smiht|rosa||full", "p|smith|rosa||full")} | {tuple(sorted((r, "p|smith|r.||weak"))) for r in readings[:6]}


def test_organisations_of_a_frequent_token_all_meet(spark):
    crowd = [f"Harlow {w} Laboratory" for w in ("Amber", "Birch", "Cedar", "Dahlia")] + ["Nimbus Foundation", "Opal Foundation", "Ruby Society of Marine Data", "Pearl Society of Marine Data"]
    names = ["Harlow Foundation", "Harlwo Foundation", "Harlow Society of Marine Data", "Harlwo Society of Marine Data", "Society of Marine Data, Harlow", "Harlow SMD", "Harlwo SMD", "Nox Society of Marine Data", "Nox SMD", "International Research Group", "Research Group International"]
    given = nv.Names(frozenset())
    readings = sorted({r for n in crowd + names for r in given.read(n, "organization")})
    want = {(a, b, r) for a in readings for b in readings if a < b and (r := nv.relation(a, b))}
    assert len(want) >= 12
    assert {(a, b, r) for a, b in met(spark, readings) if (r := nv.relation(a, b))} == want
    frame = spark.createDataFrame([(f"o{i:02d}", n, "organization", "x", "y", 1) for i, n in enumerate(names + crowd)], ENTITIES)
    groups = [(0, 1), (2, 3, 4, 5, 6), (7, 8), (9, 10)]
    linked = {(f"o{a:02d}", f"o{b:02d}") for g in groups for a in g for b in g if a < b}
    members = [tuple(r) for r in nv.variants(frame).collect()]
    assert {(a, b) for a, ca in members for b, cb in members if a < b and ca == cb} == linked


def test_similarity():
    assert abs(nv.jaro_winkler("martha", "marhta") - 0.961111) < 1e-5 and abs(nv.jaro_winkler("dixon", "dicksonx") - 0.813333) < 1e-5
    assert nv.edits("abcd", "abdc") == 1 and nv.edits("abcd", "bad") == 2
    assert nv.alike("drubitrahil", "droobritrahil") is False and nv.alike("drubritrahil", "droobritrahil")


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = [(str(rnd.randrange(300)), str(rnd.randrange(300))) for _ in range(220)] + [(f"z{i:03d}", f"z{i + 1:03d}") for i in range(60)] + [("a", "a"), (None, "b")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {x: root(x) for x in parent}


def code(name, seed, functions=8):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    return "\n".join(f"def {word()}_{word()}({word()}, limit={rnd.randrange(99)}):\n    return [x.{word()} for x in {word()} if x > {rnd.randrange(99)}]\n" for _ in range(functions))


def test_files_not_by_hand(spark):
    shared = code("lib", 77)
    files = {
        "p1/src/a.py": code("a", 1), "p2/src/b.py": code("b", 2) + '\n# writes: "Code generated by x. DO NOT EDIT." into each output', "p3/src/generated_report.py": "# Not generated: edit freely\n" + code("c", 3),
        "p1/lib/copy.py": shared, "p2/tools/copy.py": "# Lib v1.2.3\n# Permission is granted\n" + shared, "p3/x/copy.py": shared.replace("limit=", "most=", 1),
        "p1/src/g.py": "# Diese Datei wurde automatisch von gen erzeugt. Nicht bearbeiten!\n" + code("g", 5), "p1/src/m.js": "!function(e,t){" + "".join(f"var a{i}={{b:{i},c:!0}};if(!d[{i}])throw Error({i});" for i in range(60)) + "}(this);",
        "p1/src/d.ts": "export const T = [\n" + "\n".join(", ".join(f"{(i * j) % 97 / 97:.6f}" for j in range(8)) for i in range(80)) + "\n];", "p4/vendor/lib/z.go": code("z", 9), "p4/procurement/vendors/v.py": code("v", 10),
        **{f"p{i}/src/__init__.py": '"""Package marker."""' for i in range(1, 9)},
    }
    want = {"p1/lib/copy.py", "p2/tools/copy.py", "p3/x/copy.py", "p1/src/g.py", "p1/src/m.js", "p1/src/d.ts", "p4/vendor/lib/z.go", "p9/static/x.min.js"}
    nodes = spark.createDataFrame([(p, "code", 0.5, "r") for p in [*files, "p9/static/x.min.js", "p9/src/empty.py"]] + [(None, "code", 0.1, "r"), ("p1/src/t.py", None, 0.1, "r")], "id string, kind string, share double, reason string")
    rows = []
    for p, text in files.items():
        cut = [text] if len(text) < 1800 else [text[:1500], text[1300:]]
        rows += [(p.replace("/", "\\") if p.startswith("p2") else p, i, t, "q") for i, t in enumerate(cut)]
    chunks = spark.createDataFrame(rows * 2 + [(None, 0, "x", "q"), ("p1/src/a.py", None, "x", "q"), ("p1/src/a.py", 9, None, "q"), ("p1/src/a.py", 10, "", "q")], "path string, chunk_index int, content string, label string")
    assert {r["path"] for r in sf.not_by_hand(nodes, chunks).collect()} == want
    assert sf.not_by_hand(nodes.limit(0), chunks).count() == 0
    assert {r["path"] for r in sf.not_by_hand(nodes, chunks.limit(0)).collect()} == {"p4/vendor/lib/z.go", "p9/static/x.min.js"}


def found(spark, files):
    nodes = spark.createDataFrame([(p, "code") for p in files], "id string, kind string")
    chunks = spark.createDataFrame([(p, 0, t) for p, t in files.items()], "path string, chunk_index int, content string")
    return {r["path"]: r["reason"] for r in sf.not_by_hand(nodes, chunks).collect()}


def test_copies_are_found_by_their_fingerprints(spark):
    short, twice = code("s", 21, 2), code("t", 22)
    assert sf.LEAST_TOKENS <= len(sf._TOKEN.findall(short)) < sf.GRAM
    files = {f"p{i}/a.py": short for i in range(3)} | {f"q{i}/b.weird": twice for i in range(2)} | {"q1/c.weird": code("u", 23), "r/d.py": twice[: len(twice) // 2] + code("v", 24, 12), "r/e.py": "x = 1\n"}
    assert found(spark, files) == dict.fromkeys([*(f"p{i}/a.py" for i in range(3)), "q0/b.weird", "q1/b.weird"], "copy")


def test_a_licence_in_all_files_makes_no_copy(spark):
    text = "# Copyright the authors\n# " + "all rights and many more words " * 20 + "\n"
    assert found(spark, {f"p{i}/a.py": text + code("x", 100 + i) for i in range(6)}) == {}


def test_releases_in_headers():
    for header, is_one in (("// Lib v1.2.3\n", True), ("# Imported from Some-Lib 2.0 sources\n", True), ("# see section 1.2\n", False), ("# Mine v0.3.1\n", False), ("x = 1\n# Lib v1.2.3\n", False)):
        assert sf.names_release("mine-kit/src/a.py", header + "y = 2\n") is is_one


def test_overlaps_are_merged():
    text = code("t", 3, 20)
    assert sf.merge_chunks([(0, text[:900]), (1, text[700:1500]), (2, text[1300:])]) == text


def test_winnowing_meets_shared_runs():
    a, b = code("a", 1, 12), code("b", 2, 12)
    part = code("s", 3, 12)
    x, y = sf.fingerprints(a + part), sf.fingerprints(b + part + a[:50])
    assert len(np.intersect1d(x, y)) > 10 and len(np.intersect1d(sf.fingerprints(a), sf.fingerprints(b))) == 0
    assert len(sf.fingerprints("x = 1")) == 0


EASY = "The cat is on the mat. We see a red box. He has my old hat. The dog ran to the big tree. You can sit in the sun."
HARD = "The epistemology of multidimensional heteroscedasticity necessitates hermeneutic contextualisation, notwithstanding axiomatic incommensurability. Ontological indeterminacy problematises counterfactual parameterisation systematically."
LONG = "That the old hat, once it had been put on the red box by the dog that ran to the big tree in the sun, should in the end be the one thing that we all see, and sit on, and have, is on the mat of the cat less a sign of the sun than of the tree that the box, the hat and the dog can all see in the old red sun of the cat."


def test_reading_levels(spark):
    docs = [(i, f"{EASY} {EASY}", "en") for i in range(60)] + [(100 + i, HARD + " " + HARD, "en") for i in range(15)] + [(200 + i, LONG, "en") for i in range(10)]
    docs += [(300, None, "en"), (301, "", "en"), (302, "  ", "en"), (303, HARD, "de"), (304, HARD, None), (305, f"{EASY}\n\n> {HARD}\n\n```py\n{HARD}\n```\n{EASY}", "en"), (306, f"{EASY} The word hermeneutic is on the box. {EASY}", "en"), (307, "- a\n- b", "en"), (308, (HARD + " ") * 3000, "en")]
    frame = spark.createDataFrame([(*d, 1.0, 2) for d in docs], "doc_id bigint, text string, lang string, level double, n int")
    labels = spark.createDataFrame([(d, r, (2 if d < 100 else 15) + (r == "b")) for d, _, _ in docs[:85] for r in "ab"] * 2 + [(1, "c", None), (None, "c", 3), (2, "c", 99)], "doc_id bigint, rater string, grade int")
    want = {*range(100, 115), *range(200, 210), 308}
    for given in (labels, labels.limit(0)):
        found = {r["doc_id"]: r for r in rl.reading_levels(frame, given).collect()}
        assert {d for d, r in found.items() if r["demanding"]} == want
        assert found[300]["level"] is None and found[301]["level"] is None and 303 not in found and 304 not in found
    assert rl.reading_levels(frame.limit(0), labels).count() == 0


def test_every_document_has_a_level(spark):
    easy, hard = "Die alte Frau sieht den roten Hut und geht mit dem Hund zum Baum. " * 4, "Das hermeneutisch kontextualisierte, epistemologisch fundierte Theorem problematisiert kontrafaktisch parametrisierte, axiomatisch inkommensurable Systeme. " * 4
    docs = [(i, f"{EASY} {EASY}", "en") for i in range(60)] + [(100 + i, HARD + " " + HARD, "en") for i in range(10)] + [(200 + i, easy, "de") for i in range(60)]
    docs += [(300, hard, "de"), (301, easy, None), (302, hard, None), (303, None, None), (304, " ", "de"), (305, easy, "xx"), (306, f"{EASY} {EASY}", None), (307, None, "xx")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(d, "a", 2 if d < 100 else 15) for d, _, _ in docs[:70]], "doc_id bigint, rater string, grade int")
    rows = [tuple(r) for r in rl.all_reading_levels(frame, labels).collect()]
    assert sorted(r[0] for r in rows) == sorted(d for d, *_ in docs)
    english = [tuple(r) for r in rl.reading_levels(frame, labels).collect()]
    assert sorted(english) == sorted(r for r in rows if r[0] < 200)
    level = {r[0]: r[5] for r in rows}
    assert level[300] > level[200] and level[301] == level[200] and level[302] == level[300] and level[306] == level[0]
    assert all(level[d] is None for d in (303, 304, 305, 307)) and not any(r[6] for r in rows if r[0] in (303, 304, 305, 307))
    from loamgraph.llm.queries import QUERIES

    sf001 = "/root/testdata/sf0.001"
    assert QUERIES["p8_levels"](spark, sf001).select("doc_id").distinct().count() == spark.read.parquet(f"{sf001}/documents.parquet").count()


def test_sentences():
    text = 'It is, i.e. by Dr. Who, as in Fig. 3, vs. the rest. "Is it?" she said. Go! A list of things, no sentence'
    assert rl.sentences(text) == ["It is, i.e. by Dr. Who, as in Fig. 3, vs. the rest. ", '"Is it?" she said. ', "Go! "]
    assert rl.sentences("lower case list, of things.") == []
    assert rl.plain_words("The cat saw Bob Smith.") == ["cat", "saw", "the"]
