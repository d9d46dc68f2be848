"""The engine: folders or tables of texts taken in, linked, searched and walked."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.chunking import chunk_documents
from loamgraph.operators import asking, detail, entities, filegraph, fusion, graph, judging
from loamgraph.operators.lexical import LexicalIndex
from loamgraph.plans.settings import Endpoint, Settings
from loamgraph.plans.shared import materialize, new_folder
from loamgraph.plans.sql_tools import register_tools
from loamgraph.plans.store import Store
from loamgraph.sources.embedding import Embedder, HashingEmbedder, embed, query_vector
from loamgraph.sources.files import read_folder, read_texts
from loamgraph.sources.points import Collection, make_points

LOG = logging.getLogger("loamgraph")
TABLES = ("nodes", "edges", "chunks", "entities", "entity_edges")


@dataclass(frozen=True)
class Limits:
    """Bounds of what is taken in; null lifts one."""

    files: int | None = 400
    chunks_per_file: int | None = 80
    chunks: int | None = 400


#: What a table of texts is taken in with: whole.
WHOLE, ALL = Limits(None, None, None), entities.Caps(entities=None, sightings=None)


@dataclass(frozen=True)
class IngestReport:
    """``skipped`` (path, reason): files not read, and those of which a cap cut chunks off; ``truncated``: whether one
    did; ``named``: whether any entity was found."""

    files: int
    chunks: int
    skipped: DataFrame
    stats: DataFrame
    truncated: bool
    named: bool


class Engine:
    """State under one home: the point collection, and tables by the folder that was taken in.

    What is asked without a folder is asked of the one taken in last, or of the only one; of several, after a restart,
    one must be named. ``retrieve`` alone then searches all of them.
    """

    def __init__(
        self, spark: SparkSession, home: str, embedder: Embedder | None = None, caps: entities.Caps | None = None, limits: Limits | None = None, pdf_text: Callable[[bytes], str] | None = None,
        progress: Callable[[str], None] = lambda _: None, settings_folder: str | None = None, client: Callable[[Endpoint], Callable[[str], str]] | None = None,
    ):
        self.spark, self.home, self.pdf_text, self._told = spark, home.rstrip("/"), pdf_text, progress
        self._caps, self._limits, self.settings_folder, self.client = caps, limits, settings_folder, client
        self.embedder = embedder or HashingEmbedder()
        self.store = Store(spark, f"{self.home}/tables")
        self.points = Collection(spark, f"{self.home}/points", self.embedder.dims).ensure()
        self.settings = Settings.load(settings_folder) if settings_folder else Settings()
        self.current: str | None = None

    def progress(self, message: str) -> None:
        """Tell how far an ingest is, to the log and to who asked to be told."""
        LOG.info(message)
        self._told(message)

    def register_sql(self, prefix: str = "loam", folder: str | None = None) -> None:
        """Make hop and blast of a folder table functions of the session."""
        register_tools(self.spark, self.table("nodes", folder), self.table("edges", folder), prefix)

    def _folder(self, folder: str | None = None) -> str:
        known = self.store.folders()
        chosen = folder or self.current or (known[0] if len(known) == 1 else None)
        if chosen not in known:
            raise ValueError(f"unknown folder {folder}" if folder else "name a folder" if known else "no folder was taken in")
        return chosen

    def table(self, name: str, folder: str | None = None) -> DataFrame:
        return self.store.read(name, self._folder(folder))

    def scan(self, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(census, nodes, edges) of a folder, without taking it in; with its chunks and entities if it was before."""
        limits = self._limits or Limits()
        files = read_folder(self.spark, root)
        nodes, edges = self._file_graph(files, read_texts(files, self.pdf_text)[0], limits)
        if root in self.store.folders():
            nodes, edges = filegraph.graft_chunks(nodes, edges, self.store.read("chunks", root))
            nodes, edges = filegraph.graft_entities(nodes, edges, self.store.read("entities", root), self.store.read("entity_edges", root))
        return filegraph.census(files), nodes, edges

    @staticmethod
    def _file_graph(files: DataFrame, texts: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
        nodes = filegraph.file_nodes(files, most=limits.files)
        imports = filegraph.resolve(filegraph.specs(texts.select("path", "text")), files.select("path")).join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        return nodes, imports.select(*filegraph.EDGE).unionByName(filegraph.sibling_edges(nodes))

    def ingest(self, root: str, complete: Callable[[str], str] | None = None) -> IngestReport:
        """Take in a folder: chunks, vectors, entities and the graph. The usual bounds hold unless others were given."""
        files = read_folder(self.spark, root)
        texts, skipped = read_texts(files, self.pdf_text)
        return self._take(texts.select("path", "text"), root, files, skipped, complete, self._limits or Limits(), self._caps or entities.Caps())

    def ingest_table(self, texts: DataFrame, folder: str, complete: Callable[[str], str] | None = None) -> IngestReport:
        """Take in rows (path, text) as a folder; whole, unless bounds were given."""
        return self._take(texts.select("path", "text"), folder, texts, self.spark.createDataFrame([], "path string, reason string"), complete, self._limits or WHOLE, self._caps or ALL)

    def _take(self, texts: DataFrame, folder: str, files: DataFrame, skipped: DataFrame, complete: Callable[[str], str] | None, limits: Limits, caps: entities.Caps) -> IngestReport:
        self.progress("cutting texts")
        # texts are written once; all that follows reads them there
        texts, skipped = materialize(texts, "texts"), materialize(skipped, "skipped")
        nodes, edges = self._file_graph(files.select("path"), texts, limits)
        # one chunk beyond the bound of a file tells that it cut
        most = None if limits.chunks_per_file is None else limits.chunks_per_file + 1
        cut = materialize(chunk_documents(texts, "path", most=most), "cut")
        chunks = materialize(filegraph.capped_chunks(cut, limits.chunks_per_file, limits.chunks), "chunks")
        left_out = cut.select("path", "chunk_index").join(chunks.select("path", "chunk_index"), ["path", "chunk_index"], "left_anti").select("path").distinct()
        skipped = materialize(skipped.unionByName(left_out.select("path", F.concat("path", F.lit(": truncated")).alias("reason"))), "skipped")
        self.progress("embedding chunks")
        points = materialize(make_points(embed(chunks, "content", self.embedder), folder), "points")
        index = f"{self.home}/lexical/{new_folder(self.spark, 'index').rsplit('/', 1)[-1]}"
        LexicalIndex.build(chunks, index)
        self.progress("linking entities")
        # this refers to all that was written, so that the folder changes at once
        placed = self.spark.createDataFrame([(index,)], "path string")
        linked, stats = self._link(folder, chunks, nodes, edges, complete, caps)
        self.store.put(folder, {"chunks": chunks, "nodes-files": nodes, "edges-files": edges, "lexical": placed, **linked})
        self.points.replace_folder(points, folder)
        self.current = folder
        LOG.info("took in %s", folder)
        return IngestReport(texts.count(), chunks.count(), skipped, stats, bool(left_out.limit(1).count()), bool(self.table("entities").limit(1).count()))

    def _link(self, folder: str, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, complete: Callable[[str], str] | None, caps: entities.Caps) -> tuple[dict[str, DataFrame], DataFrame]:
        found = materialize(entities.mentions(chunks), "mentions")
        linked = entities.link(chunks, caps, found)
        named = embed(linked.entities.select("id", "name"), "name", self.embedder).select("id", "vector")
        between = materialize(linked.edges.unionByName(entities.conflict_edges(named, linked.entities.select("id", "mentions"), caps)), "entity-edges")
        judged = materialize(judging.adjudicate(linked.entities, complete, caps) if complete else linked.entities, "judged")
        visible = judged.where("NOT withheld").select("id")
        measured = judged.join(graph.betweenness(visible, between.where("rel = 'relates_to'")), "id", "left").join(entities.degrees(between), "id", "left")
        stored = materialize(measured.withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0))).withColumn("degree", F.coalesce("degree", F.lit(0))), "entities")
        grown, links = filegraph.graft_chunks(nodes, edges, chunks)
        grown, links = filegraph.graft_entities(grown, links, stored, between)
        return {"entities": stored, "entity_edges": between, "nodes": grown, "edges": links}, entities.statistics(stored, between, entities.candidates(chunks))

    def rebuild_entities(self, complete: Callable[[str], str] | None = None, folder: str | None = None) -> DataFrame:
        """Link the stored chunks anew, judge the names if a client is given, and graft all on the file graph."""
        folder = self._folder(folder)
        tables, stats = self._link(folder, *(self.store.read(t, folder) for t in ("chunks", "nodes-files", "edges-files")), complete, self._caps or entities.Caps())
        self.store.put(folder, tables)
        return stats

    def remove(self, folder: str) -> None:
        """Forget a folder."""
        self.store.drop(folder)
        self.points.delete_folder(folder)
        self.current = None if self.current == folder else self.current

    def retrieve(self, query: str, folder: str | None = None, limit: int = 10) -> fusion.Retrieved:
        """Hybrid retrieval in one folder; without one in all, paths then begin with the folder where there are several.

        All three lists are of the same folders."""
        known = self.store.folders()
        vector, dims = query_vector(self.embedder, query), self.embedder.dims
        if folder is None and len(known) > 1:
            tables = {t: self.store.read(t) for t in ("chunks", "entities", "entity_edges")}
            whole = lambda c: F.concat(F.col("folder"), F.lit("/"), F.col(c))
            chunks = tables["chunks"].withColumn("path", whole("path"))
            points = self.points.read().withColumn("rel_path", whole("rel_path"))
            ents = tables["entities"].withColumns({"id": whole("id"), "files": F.transform("files", lambda x: F.concat(F.col("folder"), F.lit("/"), x))})
            edges = tables["entity_edges"].withColumns({"src": whole("src"), "dst": whole("dst")})
            index = LexicalIndex.of(self.spark, {f: self.store.read("lexical", f).first()[0] for f in known})
            return fusion.retrieve(chunks, points, ents, edges, query, vector, limit, index=index, dims=dims)
        folder = self._folder(folder)
        index = LexicalIndex(self.spark, self.store.read("lexical", folder).first()[0])
        points = self.points.read().where(F.col("folder") == folder)
        return fusion.retrieve(self.table("chunks", folder), points, self.table("entities", folder), self.table("entity_edges", folder), query, vector, limit, index=index, dims=dims)

    def hop(self, focus: str, folder: str | None = None) -> DataFrame:
        return graph.hop(self.table("edges", folder), focus)

    def blast(self, focus: str, depth: int = 2, folder: str | None = None) -> DataFrame:
        return graph.blast(self.table("edges", folder), focus, depth)

    def node_detail(self, focus: str, folder: str | None = None, hits: DataFrame | None = None) -> dict[str, DataFrame]:
        """The card of a node: its row with its degree, its neighbours and passages; an entity's edges are the entity edges.

        With the ``hits`` of a retrieval, passages have the scores of the hit that is the same chunk."""
        ents, nodes = self.table("entities", folder), self.table("nodes", folder)
        row = ents.where(F.col("id") == focus)
        if row.limit(1).count():
            between = self.table("entity_edges", folder)
            card = {"node": row, "neighbours": detail.neighbours(between, nodes, ents, focus), "passages": detail.entity_passages(ents, self.table("chunks", folder), focus), "files": detail.first_files(ents, focus)}
        else:
            edges = self.table("edges", folder)
            node = nodes.where(F.col("id") == focus).withColumn("degree", detail.degree(edges, focus).scalar())
            card = {"node": node, "neighbours": detail.neighbours(edges, nodes, ents, focus), "passages": detail.node_passages(self.table("chunks", folder), focus)}
        if hits is not None:
            card["passages"] = detail.with_scores(card["passages"], hits)
        return card

    def entity_detail(self, focus: str, folder: str | None = None) -> dict[str, DataFrame]:
        ents = self.table("entities", folder)
        if not ents.where(F.col("id") == focus).limit(1).count():
            raise ValueError("unknown entity")
        return {"entity": ents.where(F.col("id") == focus), "edges": detail.incident(self.table("entity_edges", folder), focus), "chunks": detail.entity_chunks(ents, self.table("chunks", folder), focus)}

    def ask(self, question: str, complete: Callable) -> asking.Reply:
        found = lambda q: [r.asDict() for r in self.retrieve(q, limit=asking.HITS).hits.collect()]
        return asking.ask(question, complete, found, self.table("nodes"), self.table("edges"), self.table("entities"))

    # settings

    def _save(self) -> None:
        self.settings.welcome_seen = True
        if self.settings_folder:
            self.settings.save(self.settings_folder)

    def dismiss_welcome(self) -> Settings:
        self._save()
        return self.settings

    def save_endpoint(self, url: str, api_key: str, model: str) -> DataFrame:
        """Try an endpoint with a short question, keep it, and link the entities anew with its verdicts; gives their statistics."""
        url, model = url.strip(), model.strip()
        if not url or not model:
            raise ValueError("an endpoint needs an address and a model")
        if self.client is None:
            raise ValueError("no client was given for endpoints")
        endpoint = Endpoint(url, api_key, model)
        asking.probe(self.client(endpoint))
        self.settings.endpoint = endpoint
        self._save()
        return self.rebuild_entities(self.client(endpoint))

    def clear_endpoint(self) -> DataFrame:
        """Forget the endpoint and link the entities anew without verdicts."""
        self.settings.endpoint = None
        self._save()
        return self.rebuild_entities()

    def status(self) -> dict:
        """Whether the engine can answer: stored tables, dimensions, points, endpoint, and what is wrong, if anything."""
        there, error, dims, points = self.store.tables(), None, None, 0
        try:
            dims, points = len(query_vector(self.embedder, "status")), self.points.count()
            if dims != self.embedder.dims:
                error = f"the embedder gives {dims} numbers instead of {self.embedder.dims}"
        except Exception as problem:
            error = str(problem)
        ready = error is None and all(t in there for t in TABLES)
        return {"ready": ready, "tables": [t for t in TABLES if t in there], "folders": self.store.folders(), "dims": dims, "points": points, "endpoint": self.settings.has_endpoint(), "error": error}
