"""The same queries as SQL over the test tables."""

from __future__ import annotations

from loamgraph.functions.text import ACRONYM, INGESTED, KINDS, PHRASE, RESOLVED_ENDINGS, SKIPPED_FOLDERS, STARTERS, STRUCTURAL, TRIMMED, UUID
from loamgraph.operators.layout import EDGE_COLOURS, OTHER_COLOUR
from loamgraph.functions.whitespace import NOT_WS, WS

FOCUS, WALK = "entity:rank-fusion", "entity:query-echo"
BM25_QUERY, REPEATED_QUERY, RETRIEVE_QUERY = "lattice index notes on the sensor", "bridge the the archive the", "rank fusion of the hidden network"


def _quote(text: str) -> str:
    return text.replace("'", "''")


def _within(*steps: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n"



def _collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}+', ' ', 'g'))"


CORPUS = r"corpus AS (SELECT replace(path, '\', '/') AS path, chunk_index, max(content) AS content FROM chunks WHERE path IS NOT NULL AND chunk_index IS NOT NULL AND content IS NOT NULL AND content <> '' GROUP BY 1, 2)"
FILES = r"files AS (SELECT id AS path FROM nodes WHERE id NOT LIKE 'entity:%' AND NOT regexp_matches(id, '#[0-9]+$'))"
_SKIPPED = "len(list_filter(string_split(path, '/')[:-2], lambda d: starts_with(d, '.') OR suffix(d, '_files') OR d IN ({}))) > 0 OR starts_with(string_split(path, '/')[-1], '~$')".format(", ".join(f"'{d}'" for d in SKIPPED_FOLDERS))
_ENDING = r"lower(regexp_extract(string_split({}, '/')[-1], '^.+\.([^.]*)$', 1))"
_KIND = "CASE " + " ".join(f"WHEN ending IN ({', '.join(repr(e) for e in endings)}) THEN '{kind}'" for kind, endings in KINDS.items()) + " END"
CLASSIFIED = f"classified AS (SELECT path, ending, {_KIND} AS kind FROM (SELECT path, {_ENDING.format('path')} AS ending FROM files WHERE NOT ({_SKIPPED})))"
KNOWN = "known AS (SELECT path AS id, kind, string_split(path, '/')[-1] AS label FROM classified WHERE kind IS NOT NULL)"
TEXTS = "texts AS (SELECT concat(coalesce(source, 'none'), '/', doc_id, '.md') AS path, coalesce(text, '') AS text FROM documents)"


def _specs(table: str, path: str, text: str) -> str:
    quoted = " UNION ALL ".join(
        f"SELECT path, unnest(regexp_extract_all(body, '{word}{WS}*{q}([^{q}]*){q}', 1)) AS spec FROM typed" for word in ("from ", r"require\(", "import ") for q in ("''", '"')
    )
    links = rf"SELECT path, regexp_extract(unnest(regexp_extract_all(body, '\]\(([^)]*)\)', 1)), '^{WS}*({NOT_WS}+)', 1) AS spec FROM typed WHERE ending IN ('md', 'html', 'htm')"
    modules = rf"SELECT path, unnest(regexp_extract_all(body, 'mod {WS}*([A-Za-z0-9_]+){WS}*;', 1)) || '.rs' AS spec FROM typed WHERE ending = 'rs'"
    stripped = _collapse(f"replace(regexp_replace({text}, '<[^>]*(?:>|$)', '', 'g'), '>', '')")
    return f"""typed AS (SELECT path, ending, CASE WHEN kind = 'html' THEN {stripped} ELSE {text} END AS body FROM
      (SELECT *, {_KIND} AS kind FROM (SELECT {path} AS path, {text}, {_ENDING.format(path)} AS ending FROM {table} WHERE NOT ({_SKIPPED})))
      WHERE kind IS NOT NULL AND kind NOT IN ('image', 'office', 'pdf')),
specs AS (SELECT path AS src, spec FROM ({quoted} UNION ALL {modules} UNION ALL (SELECT * FROM ({links}) WHERE spec <> '')))"""


_NAME = _collapse("unnest(list_concat(regexp_extract_all(content, '" + PHRASE + "', 1), regexp_extract_all(content, '" + ACRONYM + "', 1)))")
RAW = f"""raw AS (SELECT path, chunk_index, raw, count(*) AS n FROM (SELECT path, chunk_index, {_NAME} AS raw FROM corpus)
  WHERE strlen(raw) BETWEEN 3 AND 60 AND NOT regexp_matches(raw, '{STRUCTURAL}') AND split_part(raw, ' ', 1) NOT IN ({', '.join(f"'{s}'" for s in STARTERS)}) GROUP BY ALL)"""
_TIDY = f"trim({_collapse('raw')}, '{_quote(TRIMMED)}')"
_LETTERS = r"regexp_replace(t, '[^\p{L}]', '', 'g')"
_FINE = f"""length(t) BETWEEN 3 AND 60 AND NOT regexp_matches(t, '{STRUCTURAL}') AND NOT regexp_matches(t, '{UUID}') AND length({_LETTERS}) >= 3
  AND (length(t) >= 4 OR (NOT regexp_matches({_LETTERS}, '[^\\p{{Lu}}]') AND NOT contains(t, ' ')))"""
_SLUG = "substr(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60)"
MENTIONS = f"""mentions AS (SELECT slug, surface, path, chunk_index, CAST(sum(n) AS BIGINT) AS n FROM
  (SELECT *, {_SLUG.format('surface')} AS slug FROM (SELECT path, chunk_index, n, t AS surface FROM (SELECT *, {_TIDY} AS t FROM raw) WHERE {_FINE}))
  WHERE length(slug) >= 2 GROUP BY ALL)"""
KEPT = "kept AS (SELECT 'entity:' || slug AS id, slug, CAST(sum(n) AS BIGINT) AS mentions FROM mentions GROUP BY slug HAVING sum(n) >= 2 ORDER BY mentions DESC, slug LIMIT 200)"
ALL_KEPT = KEPT.replace(" LIMIT 200", "")
LINKED = [CORPUS, RAW, MENTIONS, ALL_KEPT, "named AS (SELECT k.id, m.* FROM mentions m JOIN kept k USING (slug))"]
SURFACES = "surfaces AS (SELECT id, surface, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, surface) AS rank FROM (SELECT id, surface, CAST(sum(n) AS BIGINT) AS n FROM named GROUP BY ALL))"
MENTION_EDGES = "mention_edges AS (SELECT id AS src, path AS dst, 'mentions' AS rel, CAST(sum(n) AS BIGINT) AS weight FROM named GROUP BY id, path)"
RELATED = """there AS (SELECT DISTINCT id, path, chunk_index FROM named),
related AS (SELECT a.id AS src, b.id AS dst, 'relates_to' AS rel, count(*) AS weight FROM there a JOIN there b ON a.path = b.path AND a.chunk_index = b.chunk_index AND a.id < b.id GROUP BY a.id, b.id)"""
EDGES = "edges AS (SELECT src, dst, rel, coalesce(weight, 1) AS weight FROM entity_edges)"
ENTITIES = "ents AS (SELECT id, name, coalesce(mentions, 0) AS mentions, files, sightings, coalesce(withheld, false) AS withheld FROM entities)"
FIRST = "first AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), {})"
POINTS = "points AS (SELECT c.path AS rel_path, c.chunk_index, c.content, e.embedding AS vector FROM (SELECT *, row_number() OVER (ORDER BY path, chunk_index) - 1 AS vec_id FROM corpus) c JOIN embeddings e ON e.vec_id = c.vec_id % (SELECT count(*) FROM embeddings))"


def _bm25(name: str, query: str, limit: int) -> str:
    asked = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if len(w) > 2]
    terms = ", ".join(f"('{t}', {asked.count(t)})" for t in sorted(set(asked)))
    return f"""{name}_t(term, asked) AS (VALUES {terms}),
{name}_d AS (SELECT path, chunk_index, content, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda w: length(w) > 2) AS tokens FROM corpus),
{name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS total, greatest(avg(len(tokens)), 1.0) AS mean FROM {name}_d),
{name}_f AS (SELECT path, chunk_index, content, len(tokens) AS dl, term, asked, len(list_filter(tokens, lambda w: w = term)) AS tf FROM {name}_d, {name}_t),
{name}_i AS (SELECT term, ln(1 + (total - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) FILTER (tf > 0) AS df FROM {name}_f GROUP BY term), {name}_s),
{name} AS (SELECT path, chunk_index, score, substr(content, 1, 220) AS preview, row_number() OVER (ORDER BY score DESC, path, chunk_index) AS rank FROM
  (SELECT path, chunk_index, any_value(content) AS content, round(sum(asked * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 9) AS score FROM {name}_f JOIN {name}_i USING (term), {name}_s WHERE tf > 0 GROUP BY path, chunk_index)
  QUALIFY rank <= {limit})"""


NEAR = f"near AS (SELECT rel_path AS path, chunk_index, score, substr(content, 1, 220) AS preview, row_number() OVER (ORDER BY score DESC, rel_path, chunk_index) AS rank FROM (SELECT *, {_COS.format('vector', 'q')} AS score FROM points, first) QUALIFY rank <= {{}})"
EXPANDED = """hit_files AS (SELECT DISTINCT path FROM near),
seeds AS (SELECT DISTINCT id, mentions FROM (SELECT id, mentions, unnest(files) AS f FROM ents WHERE NOT withheld) WHERE f IN (SELECT path FROM hit_files) ORDER BY mentions DESC, id LIMIT 8),
others AS (SELECT other, max(weight) AS weight FROM (SELECT src AS id, dst AS other, weight FROM edges WHERE rel = 'relates_to' UNION ALL SELECT dst, src, weight FROM edges WHERE rel = 'relates_to') WHERE id IN (SELECT id FROM seeds) GROUP BY other),
reached AS (SELECT path, max(weight) AS score FROM (SELECT unnest(e.files) AS path, o.weight FROM ents e JOIN others o ON e.id = o.other) WHERE path NOT IN (SELECT path FROM hit_files) GROUP BY path),
expanded AS (SELECT c.path, c.chunk_index, CAST(r.score AS DOUBLE) AS score, substr(content, 1, 220) AS preview, row_number() OVER (ORDER BY r.score DESC, c.path, c.chunk_index) AS rank
  FROM corpus c JOIN reached r USING (path) WHERE NOT EXISTS (SELECT 1 FROM occupied o WHERE o.path = c.path AND o.chunk_index = c.chunk_index) QUALIFY rank <= {})"""


def _fused(*lists: tuple[str, str], limit: int) -> str:
    union = " UNION ALL ".join(f"SELECT path, chunk_index, score, preview, rank, '{name}' AS list, {i} AS number FROM {table}" for i, (table, name) in enumerate(lists))
    return f"""fused AS (SELECT path, chunk_index, sum(1 / (60.0 + rank)) AS rrf, arg_min(score, number) AS score, arg_min(preview, number) AS preview, string_agg(list, '+' ORDER BY number) AS lists
  FROM ({union}) GROUP BY path, chunk_index ORDER BY rrf DESC, path, chunk_index LIMIT {limit})"""


RETRIEVED = [CORPUS, FIRST, POINTS, ENTITIES, EDGES, NEAR.format(12), _bm25("words", RETRIEVE_QUERY, 12), "occupied AS (SELECT path, chunk_index FROM near UNION SELECT path, chunk_index FROM words)", EXPANDED.format(12), _fused(("near", "vector"), ("words", "lexical"), ("expanded", "graph"), limit=12)]
ADJACENT = "adjacent AS (SELECT src AS a, dst AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT dst, src FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)"


def _blast(depth: int) -> str:
    return _within(EDGES, ADJACENT, f"walk(id, distance) AS (SELECT '{WALK}', 0 UNION SELECT b, distance + 1 FROM walk JOIN adjacent ON id = a WHERE distance < {depth})") + f"SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM walk WHERE id <> '{WALK}' GROUP BY id"


def _sphere(i: str, n: str, radius: str) -> str:
    phi, theta = f"acos(greatest(-1.0, 1 - 2 * ({i} + 0.5) / greatest({n}, 1)))", f"pi() * (1 + sqrt(5)) * {i}"
    return f"{radius} * sin({phi}) * cos({theta}) AS x, {radius} * cos({phi}) AS y, {radius} * sin({phi}) * sin({theta}) AS z"


PLACED = f"placed AS (SELECT id, {_sphere('i', 'n', '(90.0 + 4 * least(n, 40))')} FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM known))"
_LABELLED = "LEFT JOIN (SELECT id, max(name) AS name FROM ents GROUP BY id) e USING (id) LEFT JOIN (SELECT id, max(label) AS label FROM nodes GROUP BY id) g USING (id)"
INCIDENT = f"incident AS (SELECT rel, weight, CASE WHEN src = '{FOCUS}' THEN dst ELSE src END AS id FROM edges WHERE src = '{FOCUS}' OR dst = '{FOCUS}')"
_XYZ = "round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z"
_HEX = "'0123456789abcdef'"



def _inside(i: str) -> str:
    """Whether byte i (from 0) of the hexadecimal text h continues a character."""
    return f"substr(h, 2 * ({i}) + 1, 1) IN ('8', '9', 'A', 'B')"


def _forward(i: str) -> str:
    return f"({i}) + CASE WHEN NOT {_inside(i)} THEN 0 WHEN NOT {_inside(f'{i} + 1')} THEN 1 WHEN NOT {_inside(f'{i} + 2')} THEN 2 ELSE 3 END"


def _back(i: str) -> str:
    return f"({i}) - CASE WHEN NOT {_inside(i)} THEN 0 WHEN NOT {_inside(f'{i} - 1')} THEN 1 WHEN NOT {_inside(f'{i} - 2')} THEN 2 ELSE 3 END"


def _stop(source: str) -> str:
    """Where the chunk that starts at ``start`` stops: after the last empty line or line end of its bytes, else hard."""
    empty, line = "chr(10) || chr(10)", "chr(10)"
    return f"""SELECT doc_id, h, n, start, CASE WHEN hard >= n THEN hard WHEN contains(w, {empty}) THEN hard - strlen(ltrim(list_last(string_split(w, {empty})), {line}))
      WHEN contains(w, {line}) THEN hard - strlen(list_last(string_split(w, {line}))) ELSE hard END AS stop
      FROM (SELECT *, decode(unhex(substr(h, 2 * start + 1, 2 * (hard - start)))) AS w FROM (SELECT *, {_forward('least(start + 1800, n)')} AS hard FROM ({source})))"""


_ENDS = f"regexp_replace({{}}, '^{WS.replace('{', '{{').replace('}', '}}')}+|{WS.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"
_NEXT = _back("greatest(stop - 200, 0)")
CHUNKED = [
    f"whole AS (SELECT doc_id, hex(encode(t)) AS h, strlen(t) AS n, CAST(0 AS BIGINT) AS start FROM (SELECT doc_id, {_ENDS.format('text')} AS t FROM documents WHERE text IS NOT NULL) WHERE t <> '')",
    f"cuts AS ({_stop('SELECT * FROM whole')} UNION ALL {_stop(f'SELECT doc_id, h, n, CASE WHEN {_NEXT} <= start THEN stop ELSE {_NEXT} END AS start FROM cuts WHERE stop < n')})",
    f"pieces AS (SELECT doc_id, start, {_ENDS.format('decode(unhex(substr(h, 2 * start + 1, 2 * (stop - start))))')} AS content FROM cuts)",
]

SQL: dict[str, str] = {
    "chunk_documents": _within(*CHUNKED) + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, content FROM pieces WHERE content <> ''",
    "census_by_kind": _within(FILES, CLASSIFIED) + "SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS) + ", count(*) FILTER (kind IS NULL) AS skipped FROM classified",
    "census_samples": _within(FILES, CLASSIFIED) + "SELECT path FROM classified WHERE kind IS NOT NULL ORDER BY path LIMIT 12",
    "census_truncated": _within(FILES, CLASSIFIED, "firsts AS (SELECT kind FROM classified ORDER BY path LIMIT 100)") + "SELECT (SELECT count(*) FROM classified) > 100 AS truncated, count(*) FILTER (kind IS NULL) AS skipped FROM firsts",
    "files_classified": _within(FILES, CLASSIFIED) + "SELECT path, ending, kind FROM classified",
    "files_walk_filtered": _within(FILES, "moved AS (SELECT concat(CASE length(path) % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.cache/' WHEN 2 THEN 'page_files/' ELSE '' END, path) AS path FROM files)") + f"SELECT path FROM moved WHERE {_SKIPPED}",
    "file_nodes_capped": _within(FILES, CLASSIFIED, KNOWN) + "SELECT id, kind, label FROM known ORDER BY id LIMIT 400",
    "strip_html_documents": "SELECT doc_id, " + _collapse("replace(regexp_replace(text, '<[^>]*(?:>|$)', '', 'g'), '>', '')") + " AS body FROM documents WHERE text IS NOT NULL",
    "chunk_caps": _within(CORPUS) + "SELECT path, chunk_index FROM (SELECT path, chunk_index, row_number() OVER (PARTITION BY path ORDER BY chunk_index) AS nth FROM corpus) WHERE nth <= 80 ORDER BY path, chunk_index LIMIT 400",
    "chunk_nodes": _within(CORPUS) + r"SELECT path || '#' || chunk_index AS id, 'chunk' AS kind, regexp_replace(string_split(path, '/')[-1], '^(.+)\.[^.]*$', '\1') || '#' || chunk_index AS label FROM corpus",
    "chunk_contains_edges": _within(CORPUS, FILES, CLASSIFIED, KNOWN) + "SELECT path AS src, path || '#' || chunk_index AS dst, 'contains' AS rel, CAST(1 AS BIGINT) AS weight FROM corpus WHERE path IN (SELECT id FROM known)",
    "chunk_next_edges": _within(CORPUS) + "SELECT path || '#' || chunk_index AS src, path || '#' || after AS dst, 'next' AS rel, CAST(1 AS BIGINT) AS weight FROM (SELECT path, chunk_index, lead(chunk_index) OVER (PARTITION BY path ORDER BY chunk_index) AS after FROM corpus) WHERE after IS NOT NULL",
    "sibling_edges": _within(FILES, CLASSIFIED, KNOWN)
    + """SELECT src, dst, 'sibling' AS rel, CAST(1 AS BIGINT) AS weight FROM (SELECT id AS src, coalesce(lead(id) OVER w, CASE WHEN count(*) OVER (PARTITION BY folder) > 2 THEN min(id) OVER (PARTITION BY folder) END) AS dst
      FROM (SELECT DISTINCT id, regexp_extract(id, '^(.*)/[^/]*$', 1) AS folder FROM known) WINDOW w AS (PARTITION BY folder ORDER BY id)) WHERE dst IS NOT NULL""",
    "md_link_specs": _within(TEXTS, _specs("texts", "path", "text")) + "SELECT src, spec, count(*) AS n FROM specs GROUP BY ALL",
    "code_import_specs": _within(CORPUS, _specs("corpus", "path", "content")) + "SELECT src, spec, count(*) AS n FROM specs GROUP BY ALL",
    "import_resolve": _within(
        """files AS (SELECT concat('docs/', doc_id, '.md') AS path, concat(coalesce(text, ''), chr(10), 'import x from ''./', doc_id + 1, '''', chr(10), '[a](./', doc_id + 2, '.md)') AS text FROM documents)""",
        _specs("files", "path", "text"),
        r"local AS (SELECT src, row_number() OVER () AS nth, regexp_extract(src, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(spec, '^(?:\./)+', '') AS bare FROM specs WHERE NOT regexp_matches(spec, '^(?:https?:|mailto:|crate:|@)'))",
        "tried AS (SELECT src, nth, CASE WHEN starts_with(bare, '/') OR folder = '' THEN bare ELSE folder || '/' || bare END AS start FROM local WHERE bare <> '' AND NOT starts_with(bare, 'node_modules/'))",
        "endings(place, e) AS (VALUES " + ", ".join(f"({i}, '{e}')" for i, e in enumerate(RESOLVED_ENDINGS)) + ")",
        "hits AS (SELECT src, nth, arg_min(start || e, place) AS dst FROM tried, endings WHERE start || e IN (SELECT path FROM files) GROUP BY src, nth)",
    )
    + "SELECT src, dst, 'imports' AS rel, count(*) AS weight FROM hits WHERE src <> dst GROUP BY ALL",
    "graft_chunks": _within(CORPUS, "made AS (SELECT path || '#' || chunk_index AS id FROM corpus)", "after AS (SELECT path, chunk_index, lead(chunk_index) OVER (PARTITION BY path ORDER BY chunk_index) AS following FROM corpus)")
    + """SELECT id, 'node' AS what FROM nodes UNION ALL SELECT id, 'node' FROM made WHERE id NOT IN (SELECT id FROM nodes)
      UNION ALL SELECT path || ' contains ' || path || '#' || chunk_index, 'edge' FROM corpus WHERE path IN (SELECT id FROM nodes)
      UNION ALL SELECT path || '#' || chunk_index || ' next ' || path || '#' || following, 'edge' FROM after WHERE following IS NOT NULL""",
    "graft_entities": """WITH known AS (SELECT id FROM nodes WHERE kind IN ('markdown', 'text')), hidden AS (SELECT id FROM entities WHERE withheld)
      SELECT id, 'node' AS what FROM known UNION ALL SELECT id, 'node' FROM entities WHERE NOT coalesce(withheld, false) AND id NOT IN (SELECT id FROM known)
      UNION ALL SELECT concat_ws(' ', src, coalesce(rel, '?'), dst), 'edge' FROM entity_edges WHERE NOT EXISTS (SELECT 1 FROM hidden WHERE id = src) AND NOT EXISTS (SELECT 1 FROM hidden WHERE id = dst)""",
    "point_ids": _within(CORPUS, "hashed AS (SELECT path, chunk_index, sha256('lab:' || path || '#' || chunk_index) AS h FROM corpus)")
    + f"SELECT path, chunk_index, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '4' || substr(h, 14, 3), substr('89ab', CAST(((strpos({_HEX}, substr(h, 17, 1)) - 1) & 3) + 1 AS BIGINT), 1) || substr(h, 18, 3), substr(h, 21, 12)) AS id FROM hashed",
    "entity_candidates": _within(CORPUS, RAW) + "SELECT path, chunk_index, raw, n FROM raw",
    "entity_normalize": _within(CORPUS, RAW) + f"SELECT raw, CASE WHEN {_FINE} THEN t END AS name, {_SLUG.format('raw')} AS slug FROM (SELECT DISTINCT raw, {_TIDY} AS t FROM raw)",
    "entity_mentions": _within(CORPUS, RAW, MENTIONS) + "SELECT slug, surface, path, chunk_index, n FROM mentions",
    "entity_top200": _within(CORPUS, RAW, MENTIONS, KEPT) + "SELECT id, slug, mentions FROM kept",
    "entity_names_aliases": _within(*LINKED, SURFACES) + "SELECT id, surface, n, rank FROM surfaces",
    "entity_merge_notes": _within("raw AS (SELECT path, chunk_index, surface AS raw, cnt AS n FROM sightings WHERE path IS NOT NULL AND chunk_index IS NOT NULL AND cnt IS NOT NULL)", MENTIONS, "named AS (SELECT 'entity:' || slug AS id, * FROM mentions)", SURFACES) + "SELECT id, any_value(surface) FILTER (rank = 1) AS name, string_agg(surface, '|' ORDER BY rank) FILTER (rank > 1) AS aliases, string_agg(surface, '|' ORDER BY rank) AS surfaces FROM surfaces GROUP BY id HAVING count(*) > 1",
    "entity_files_mentions": _within(*LINKED, MENTION_EDGES) + "SELECT * FROM mention_edges",
    "entity_sightings_top16": _within(*LINKED) + "SELECT * FROM (SELECT id, path, chunk_index, surface, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, path, chunk_index, surface) AS rank FROM named) WHERE rank <= 16",
    "entity_relates_to": _within(*LINKED, RELATED) + "SELECT * FROM related",
    "entity_stats": _within(*LINKED, SURFACES, MENTION_EDGES, RELATED)
    + """SELECT (SELECT count(*) FROM kept) AS entities, (SELECT count(*) FROM kept) AS visible, CAST(0 AS BIGINT) AS withheld, (SELECT count(*) FROM (SELECT src FROM mention_edges GROUP BY src HAVING count(*) > 1)) AS cross_file,
      (SELECT count(*) FROM (SELECT id FROM surfaces GROUP BY id HAVING count(*) > 1)) AS merges, (SELECT count(*) FROM raw) AS candidates, (SELECT count(*) FROM mention_edges) AS mentions, (SELECT count(*) FROM related) AS relates_to, CAST(0 AS BIGINT) AS conflicts""",
    "entity_degree": _within(EDGES) + "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges WHERE (rel <> 'mentions' OR rel IS NULL) AND src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT dst FROM edges WHERE (rel <> 'mentions' OR rel IS NULL) AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst) GROUP BY id",
    "entity_betweenness_top200": _within(
        *(KEPT if step is ALL_KEPT else step for step in LINKED),
        RELATED,
        "near AS (SELECT src AS a, dst AS b FROM related UNION SELECT dst, src FROM related)",
        "walk(s, t, d) AS (SELECT id, id, 0 FROM kept UNION SELECT s, b, d + 1 FROM walk JOIN near ON t = a WHERE d < 6)",
        "dist AS (SELECT s, t, min(d) AS d FROM walk GROUP BY s, t)",
        "paths(s, t, d) AS (SELECT id, id, 0 FROM kept UNION ALL SELECT p.s, n.b, p.d + 1 FROM paths p JOIN near n ON p.t = n.a JOIN dist x ON x.s = p.s AND x.t = n.b AND x.d = p.d + 1)",
        "sigma AS (SELECT s, t, d, CAST(count(*) AS DOUBLE) AS n FROM paths GROUP BY s, t, d)",
        "parts AS (SELECT a.t AS id, sum(a.n * b.n / c.n) AS part FROM sigma a JOIN sigma b ON a.t = b.s JOIN sigma c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.t)",
    )
    + "SELECT id, round(coalesce(part, 0) / ((SELECT count(*) FROM kept) - 1) / ((SELECT count(*) FROM kept) - 2), 6) AS betweenness FROM kept LEFT JOIN parts USING (id)",
    "conflicts_with": "WITH judged AS (SELECT 'vec:' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY (vec_id * 7919) % 1000 DESC, id LIMIT 80), pairs AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS s FROM judged a JOIN judged b ON a.id < b.id) SELECT src, dst, 'conflicts_with' AS rel, CAST(least(greatest(round(s * 100), 0), 100) AS BIGINT) AS weight FROM pairs WHERE s >= 0.2",
    "vector_topk": f"WITH {FIRST} SELECT vec_id, round({_COS.format('embedding', 'q')}, 6) AS score FROM embeddings, first ORDER BY {_COS.format('embedding', 'q')} DESC, vec_id LIMIT 10",
    "vector_topk_filtered": f"WITH {FIRST} SELECT vec_id, round({_COS.format('embedding', 'q')}, 6) AS score FROM embeddings, first WHERE label = 3 ORDER BY {_COS.format('embedding', 'q')} DESC, vec_id LIMIT 10",
    "vector_nearest": f"WITH scored AS (SELECT a.vec_id AS query, b.vec_id AS point, {_COS.format('a.embedding', 'CAST(b.embedding AS DOUBLE[])')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT query, point, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, point) AS rank FROM scored) WHERE rank <= 5",
    "near_pairs": f"WITH scored AS (SELECT least(a.vec_id, b.vec_id) AS a, greatest(a.vec_id, b.vec_id) AS b, {_COS.format('a.embedding', 'CAST(b.embedding AS DOUBLE[])')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT a, b, round(max(score), 6) AS score FROM scored WHERE score >= 0.3 GROUP BY a, b",
    "tokenize_documents": "WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term",
    "bm25_postings": _within(CORPUS, "d AS (SELECT path, chunk_index, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda w: length(w) > 2) AS tokens FROM corpus)") + "SELECT path, chunk_index, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT path, chunk_index, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY path, chunk_index, term",
    "bm25_topk": _within(CORPUS, _bm25("words", BM25_QUERY, 20)) + "SELECT path, chunk_index, round(score, 6) AS score, preview FROM words",
    "bm25_repeated_term": _within(CORPUS, _bm25("words", REPEATED_QUERY, 20)) + "SELECT path, chunk_index, round(score, 6) AS score, preview FROM words",
    "graph_expand": _within(CORPUS, FIRST, POINTS, ENTITIES, EDGES, NEAR.format(8), "occupied AS (SELECT path, chunk_index FROM near)", EXPANDED.format(12)) + "SELECT path, chunk_index, score, preview FROM expanded",
    "rrf_fuse": _within(CORPUS, _bm25("a", BM25_QUERY, 20), _bm25("b", REPEATED_QUERY, 20), _fused(("a", "a"), ("b", "b"), limit=15)) + "SELECT path, chunk_index, round(score, 6) AS score, round(rrf, 6) AS rrf_score, lists, preview FROM fused",
    "retrieve_hybrid": _within(*RETRIEVED) + "SELECT path, chunk_index, round(score, 6) AS score, round(rrf, 6) AS rrf_score, lists, preview FROM fused",
    "retrieve_provenance": _within(*RETRIEVED) + "SELECT " + ", ".join(f"count(*) FILTER (list_contains(string_split(lists, '+'), '{n}')) AS via_{n}" for n in ("vector", "lexical", "graph")) + " FROM fused",
    "retrieve_graph_only_files": _within(*RETRIEVED) + "SELECT DISTINCT path FROM fused WHERE lists = 'graph'",
    "hop": _within(EDGES, ADJACENT) + f"SELECT b AS id FROM adjacent WHERE a = '{FOCUS}'",
    "blast_depth1": _blast(1),
    "blast_depth2": _blast(2),
    "blast_depth3": _blast(3),
    "node_card_neighbors": _within(EDGES, ENTITIES, INCIDENT) + f"SELECT rel, weight, id, coalesce(name, label, id) AS label FROM incident {_LABELLED}",
    "node_card_strongest": _within(EDGES, INCIDENT) + "SELECT rel, weight, id, CASE WHEN rel = 'conflicts_with' THEN 'similarity ' || format('{:.2f}', weight / 100) ELSE 'w ' || weight END AS shown FROM incident ORDER BY weight DESC, id, rel NULLS FIRST LIMIT 16",
    "node_card_passages": _within(CORPUS, ENTITIES) + f"SELECT s.path, s.chunk_index, s.surface, coalesce(substr(c.content, 1, 280), '') AS excerpt FROM (SELECT unnest(sightings) AS s FROM ents WHERE id = '{FOCUS}') LEFT JOIN corpus c ON c.path = s.path AND c.chunk_index = s.chunk_index",
    "node_card_file": _within(CORPUS) + "SELECT path, chunk_index, '' AS surface, substr(content, 1, 280) AS excerpt FROM corpus WHERE path = (SELECT min(path) FROM corpus) ORDER BY chunk_index LIMIT 6",
    "entity_detail_chunks": _within(CORPUS, ENTITIES) + f"SELECT path, chunk_index, content FROM corpus WHERE path IN (SELECT unnest(files) FROM ents WHERE id = '{FOCUS}')",
    "node_labels": _within(EDGES, ADJACENT, ENTITIES) + f"SELECT id, coalesce(name, label, id) AS label FROM (SELECT b AS id FROM adjacent WHERE a = '{FOCUS}') {_LABELLED}",
    "node_degrees": _within(EDGES) + f"SELECT count(*) AS degree FROM edges WHERE src = '{FOCUS}' OR dst = '{FOCUS}'",
    "card_first_passages": _within(CORPUS, ENTITIES) + f"SELECT s.path, s.chunk_index, s.surface, coalesce(substr(c.content, 1, 280), '') AS excerpt FROM (SELECT unnest(sightings) AS s FROM ents WHERE id = '{FOCUS}') LEFT JOIN corpus c ON c.path = s.path AND c.chunk_index = s.chunk_index ORDER BY 1, 2, 3 LIMIT 8",
    "card_first_files": f"SELECT unnest(files[1:8]) AS path, CAST(len(files) AS INTEGER) AS n FROM entities WHERE id = '{FOCUS}'",
    "card_hit_scores": _within(CORPUS, _bm25("a", BM25_QUERY, 20), _bm25("b", REPEATED_QUERY, 20), _fused(("a", "a"), ("b", "b"), limit=15)) + "SELECT c.path, c.chunk_index, round(score, 6) AS score, round(rrf, 6) AS rrf_score, lists FROM corpus c LEFT JOIN fused f ON f.path = c.path AND f.chunk_index = c.chunk_index",
    "edge_colours": _within(EDGES) + "SELECT src, dst, rel, CASE rel " + " ".join(f"WHEN '{rel}' THEN '{colour}'" for rel, colour in EDGE_COLOURS.items()) + f" ELSE '{OTHER_COLOUR}' END AS colour FROM edges",
    "files_ingestable": _within(FILES, CLASSIFIED) + "SELECT path FROM classified WHERE kind IN (" + ", ".join(f"'{k}'" for k in INGESTED) + ")",
    "points_count": _within(CORPUS, POINTS) + "SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS n FROM points GROUP BY 1",
    "points_scroll": _within(CORPUS, POINTS) + "SELECT rel_path, chunk_index FROM points WHERE split_part(rel_path, '/', 1) = (SELECT min(split_part(rel_path, '/', 1)) FROM points)",
    "points_delete_upsert": _within(CORPUS, POINTS)
    + "SELECT rel_path || '#' || chunk_index AS id, split_part(rel_path, '/', 1) AS folder, chunk_index, CASE WHEN chunk_index = 0 THEN 'changed' ELSE content END AS content FROM points WHERE chunk_index = 0 OR split_part(rel_path, '/', 1) <> (SELECT min(split_part(rel_path, '/', 1)) FROM points)",
    "layout_sphere": _within(FILES, CLASSIFIED, KNOWN, PLACED) + f"SELECT id, {_XYZ} FROM placed",
    "layout_entity_radius": _within(
        EDGES,
        "degrees AS (SELECT e.id, count(x.id) AS degree FROM entities e LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) x USING (id) GROUP BY e.id)",
        f"far AS (SELECT id, degree, radius, {_sphere('i', 'n', 'radius')} FROM (SELECT id, degree, least(420.0, 32 + log2(degree + 1) * 4 * 11) AS radius, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM degrees))",
    )
    + f"SELECT id, degree, round(radius, 6) AS radius, {_XYZ} FROM far",
    "layout_chunk_ring": _within(
        CORPUS,
        FILES,
        CLASSIFIED,
        KNOWN,
        PLACED,
        f"ring AS (SELECT path, chunk_index, {_sphere('i', 'n', 'greatest(13.0, (16 + 0.5 * least(n, 40)) * 1.0)')} FROM (SELECT path, chunk_index, row_number() OVER (PARTITION BY path ORDER BY chunk_index) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM corpus))",
        "moved AS (SELECT path || '#' || chunk_index AS id, p.x + r.x AS x, p.y + r.y AS y, p.z + r.z AS z FROM ring r JOIN placed p ON p.id = r.path)",
    )
    + f"SELECT id, {_XYZ} FROM moved",
    "membranes": _within(EDGES, ADJACENT, "sixth AS (SELECT a AS id, b, row_number() OVER (PARTITION BY a ORDER BY b) AS place FROM adjacent WHERE a <> b QUALIFY place <= 6)")
    + "SELECT id, b, c FROM (SELECT id, b, coalesce(lead(b) OVER (PARTITION BY id ORDER BY place), min(b) OVER (PARTITION BY id)) AS c, count(*) OVER (PARTITION BY id) AS n FROM sixth) WHERE n > 1",
    "edge_tubes": _within(EDGES) + "SELECT src, dst, rel, round(CASE WHEN contains(dst, '#') THEN 0.28 WHEN NOT starts_with(dst, 'entity:') THEN 0.55 ELSE 0.12 + ln(weight + 1) * 0.16 END, 6) AS radius FROM edges",
}
