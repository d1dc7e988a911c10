"""The facade: a source tree, its stored graph, and every operator on it."""

from __future__ import annotations

import os
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import context, cycles, embed, reads, resolve, search, sync, traversal
from graphloom.schemas import EMBEDDABLE, ORDER
from graphloom.operators.textindex import TextIndex
from graphloom.sources import files, tree
from graphloom.sources.store import BUCKET_BYTES, LEAST_BUCKETS, PATH_OF, Config, Store, empty
from graphloom.storage import written

FOLDER = ".graphloom"
#: A text index with more segments is made one at the next sync.
MOST_SEGMENTS = 16


@dataclass
class SyncReport:
    """What a sync did: files opened, references resolved, buckets written for changed files and for edges."""

    read: int = 0
    resolved: int = 0
    touched: list[int] = field(default_factory=list)
    relinked: list[int] = field(default_factory=list)


@dataclass
class IndexResult:
    success: bool
    files_indexed: int
    files_skipped: int
    files_errored: int
    nodes_created: int
    edges_created: int


class CodeGraph:
    """A graph over the tree at ``root``; tables are read lazily from the current snapshot."""

    def __init__(self, spark: SparkSession, root: str, store: Store, model: embed.Model | None = None):
        self.spark, self.root, self.store = spark, root.rstrip("/"), store
        self.config = store.config()
        self.model = model or embed.hashed_model(self.config.embedding_dimensions)
        self.last_sync = SyncReport()

    # --- life cycle

    @classmethod
    def init(cls, spark: SparkSession, root: str, config: Config | None = None, model: embed.Model | None = None) -> CodeGraph:
        store = Store(spark, f"{root.rstrip('/')}/{FOLDER}")
        if store.exists():
            raise FileExistsError(f"{root} has a graph already")
        store.save_config(config or Config())
        store.clear()
        return cls(spark, root, store, model)

    @classmethod
    def open(cls, spark: SparkSession, root: str, model: embed.Model | None = None) -> CodeGraph:
        store = Store(spark, f"{root.rstrip('/')}/{FOLDER}")
        if not store.exists():
            raise FileNotFoundError(f"{root} has no graph")
        return cls(spark, root, store, model)

    @staticmethod
    def is_initialized(spark: SparkSession, root: str) -> bool:
        return Store(spark, f"{root.rstrip('/')}/{FOLDER}").exists()

    @staticmethod
    def nearest_root(path: str) -> str | None:
        """The nearest folder, from a local path upwards, that has a graph."""
        path = os.path.abspath(path)
        while not os.path.isdir(os.path.join(path, FOLDER)):
            if os.path.dirname(path) == path:
                return None
            path = os.path.dirname(path)
        return path

    # --- tables

    def _table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        found = self.store.table(name, buckets)
        if found is None:
            raise LookupError("nothing is indexed yet")
        return found

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges").drop("file_path")

    @property
    def sources(self) -> DataFrame:
        return self._table("sources")

    @property
    def embeddings(self) -> DataFrame | None:
        found = self.store.table("embeddings") if self.config.embed_symbols else None
        return found.drop("file_path") if found is not None else None

    @property
    def text(self) -> TextIndex | None:
        """The text index as the current state has it."""
        state = self.store.state().get("text")
        return TextIndex(self.spark, f"{self.store.path}/text", state=state) if state else None

    def _commit(self, tables: dict, buckets: int | None, base: int, text: TextIndex) -> None:
        self.store.commit(tables, buckets, base, text=text.state())
        text.forget({s for v in self.store.manifests.numbers() for s in self.store.state(v).get("text", {}).get("segments", [])})

    # --- indexing

    def _listed(self) -> DataFrame:
        """The tree's files as they are now, and when they were listed; no file is opened."""
        exclude = (*self.config.exclude, f"{FOLDER}/**")
        return written(tree.listing(self.spark, self.root, exclude, self.config.max_file_size, tuple(self.config.languages)).withColumn("listed", F.current_timestamp()), "listed")

    def _read(self, listed: DataFrame) -> DataFrame:
        return written(tree.read_texts(listed, self.root), "sources")

    def _embedded(self, nodes: DataFrame, have: DataFrame | None) -> DataFrame:
        """(node_id, embedding, file_path) of the nodes that ``have`` lacks, and the rows of ``have``."""
        some = nodes.where(F.col("kind").isin(*EMBEDDABLE))
        if have is not None:
            some = sync.missing_embeddings(nodes, have)
        new = embed.embed_texts(some, "id", embed.node_text(), self.model, self.config.embedding_batch_size)
        new = new.join(nodes.select(F.col("id").alias("node_id"), "file_path"), "node_id")
        return new if have is None else have.unionByName(new)

    @staticmethod
    def _file_rows(made: files.Extracted, texts: DataFrame, listed: DataFrame) -> DataFrame:
        stamps = listed.select("path", "length", "modified", "listed")
        return made.files.join(stamps.join(texts.select("path"), "path", "left_semi"), "path")

    @staticmethod
    def _own_rows(made: files.Extracted) -> DataFrame:
        """What files define themselves, with the file."""
        return made.edges.join(made.nodes.select(F.col("id").alias("source"), "file_path").distinct(), "source")

    @staticmethod
    def _edge_rows(own: DataFrame, links: DataFrame) -> DataFrame:
        """Edges from what files define and from what references lead to; equal ones have one source and so one file."""
        columns = ["file_path", "source", "target", "kind", "line", "column"]
        return reads.dedupe_edges(own.select(columns).unionByName(links.select(columns).distinct()))

    def index_all(self) -> IndexResult:
        """Reads, extracts and links the whole tree into a new state; one index or sync runs at a time."""
        with self.store.lock():
            return self._index_all()

    def _index_all(self) -> IndexResult:
        base = self.store.version()
        everything = tree.all_files(self.spark, self.root).where(~F.col("path").startswith(f"{FOLDER}/")).count()
        listed = self._listed()
        texts = self._read(listed)
        made = files.extract_all(texts.select("path", "language", "content_hash", "text"))
        known = made.files.select("path")
        links = written(resolve.links(made.refs, made.nodes, known, resolve.source_files(made.imports, known)), "links")
        own = written(self._own_rows(made), "own")
        edges = written(reads.prune_dangling(self._edge_rows(own, links), made.nodes), "edges")
        tables = {"files": self._file_rows(made, texts, listed), "nodes": made.nodes, "own": own, "refs": made.refs, "imports": made.imports, "links": links, "edges": edges, "sources": texts.drop("length", "modified")}
        tables["embeddings"] = self._embedded(made.nodes, None) if self.config.embed_symbols else empty(self.spark).withColumn("file_path", F.lit("").cast("string"))
        size = listed.agg(F.sum("length")).first()[0] or 0
        text = TextIndex.build(made.nodes, f"{self.store.path}/text", search.TEXT_COLUMNS, kept=True)
        self._commit({k: (v, None) for k, v in tables.items()}, max(LEAST_BUCKETS, size // BUCKET_BYTES), base, text)
        indexed, errored = made.files.count(), made.errors.count()
        return IndexResult(errored == 0 or indexed > errored, indexed - errored, everything - indexed, errored, made.nodes.count(), edges.count())

    def _looks(self) -> tuple[DataFrame, DataFrame]:
        """The tree as listed, and (path, look) of files whose time or length says that they may have changed: 'new', 'gone' or
        'other'.  A file that was changed within two seconds of its last listing may have changed again at the same time and
        counts too.  No file is opened."""
        listed = self._listed()
        old = self._table("files").select(F.col("path").alias("_old"), F.col("length").alias("_length"), F.col("modified").alias("_modified"), F.col("listed").alias("_listed"))
        both = old.join(listed, F.col("_old") == F.col("path"), "full_outer")
        racy = F.col("_modified") >= F.col("_listed") - F.expr("interval 2 seconds")
        other = ~F.col("length").eqNullSafe(F.col("_length")) | ~F.col("modified").eqNullSafe(F.col("_modified")) | F.coalesce(racy, F.lit(True))
        look = F.when(F.col("_old").isNull(), "new").when(F.col("path").isNull(), "gone").when(other, "other")
        return listed, both.select(F.coalesce("path", "_old").alias("path"), look.alias("look")).where("look is not null")

    def sync(self) -> dict[str, int]:
        """Brings the state up to the tree; the result equals that of a full index.  Counts by status.

        Only files that look changed are opened, only changed ones parsed; references are resolved again only if a definition,
        import or file changed that they may lead to; only touched buckets are written.  ``last_sync`` tells what was done.
        """
        with self.store.lock():
            return self._sync()

    def _sync(self) -> dict[str, int]:
        base = self.store.version()
        if self.store.table("files") is None:
            return {"added": self._index_all().files_indexed}
        listed, looks = self._looks()
        looks = written(looks, "looks")
        texts = self._read(listed.join(looks.where("look <> 'gone'"), "path", "left_semi"))
        stored = self._table("files").select("path", "content_hash")
        status = written(sync.file_status(stored.join(looks, "path", "left_semi"), texts), "status")
        counts = {r["status"]: r["n"] for r in sync.status_counts(status).collect()}
        same = stored.count() - sum(counts.get(k, 0) for k in ("removed", "modified"))
        counts |= {"unchanged": same} if same else {}
        self.last_sync = SyncReport(read=texts.count())
        if not set(counts) - {"unchanged"}:
            return counts
        buckets = self.store.state(base)["buckets"]
        touched_by = lambda df, column: sorted({r[0] for r in df.select(Store.bucket_of(F.col(column), buckets)).distinct().collect()})
        changed = status.where("status <> 'unchanged'").select("path", "status")
        touched = touched_by(changed, "path")
        fresh = texts.join(changed, "path", "left_semi")
        made = files.extract_all(fresh.select("path", "language", "content_hash", "text"))
        new = {"files": self._file_rows(made, fresh, listed), "nodes": made.nodes, "own": self._own_rows(made), "refs": made.refs, "imports": made.imports, "sources": fresh.drop("length", "modified")}

        def merged(name: str) -> DataFrame:
            column = PATH_OF.get(name, "file_path")
            rest = self._table(name, touched).join(changed.select(F.col("path").alias(column)), column, "left_anti")
            return written(rest.unionByName(new[name]).select(*rest.columns), name)

        now = {name: merged(name) for name in new}
        others = [b for b in range(buckets) if b not in set(touched)]
        whole = {name: self._table(name, others).unionByName(now[name]) for name in ("files", "nodes", "refs", "imports")}

        was = self._table("nodes", touched).join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        names = written(resolve.changed_names(was, made.nodes), "names")
        moved = changed.where("status <> 'modified'").select("path")
        moved = None if moved.isEmpty() else written(moved, "moved")
        depend = resolve.dependents(whole["refs"], whole["imports"], names, moved)
        refs = written(depend.unionByName(resolve.with_ids(made.refs)).dropDuplicates(["ref_id"]), "dependents")
        known = whole["files"].select("path")
        imports = written(resolve.source_files(whole["imports"].join(refs.select("file_path").distinct(), "file_path", "left_semi"), known), "imports")
        found = written(resolve.links(refs.drop("ref_id"), resolve.wanted(whole["nodes"], refs, imports), known, imports), "links")
        relinked = sorted({*touched, *touched_by(refs, "file_path")})
        kept = self._table("links", relinked).join(changed.select(F.col("path").alias("file_path")), "file_path", "left_anti").join(refs.select("ref_id"), "ref_id", "left_anti")
        links = written(kept.unionByName(found), "links")
        own = self._table("own", [b for b in relinked if b not in set(touched)]).unionByName(now["own"])
        edges = written(reads.prune_dangling(self._edge_rows(own, links), whole["nodes"].select("id")), "edges")

        tables = {name: (df, touched) for name, df in now.items()} | {"links": (links, relinked), "edges": (edges, relinked)}
        if self.config.embed_symbols:
            gone = written(sync.stale_embeddings(was, made.nodes), "stale")
            have = self._table("embeddings", touched).join(gone, F.col("node_id") == F.col("id"), "left_anti")
            tables["embeddings"] = (written(self._embedded(now["nodes"], written(have, "embeddings")), "embeddings"), touched)
        text = self.text.change(made.nodes, was.select("id"))
        if len(text.segments) > MOST_SEGMENTS:
            text = text.compact()
        self._commit(tables, None, base, text)
        self.last_sync = SyncReport(self.last_sync.read, refs.count(), touched, relinked)
        return counts

    def is_dirty(self) -> bool:
        """Whether any file differs from the state's.  Files are opened only if their time or length differs."""
        if self.store.table("files") is None:
            return True
        listed, looks = self._looks()
        looks = written(looks, "looks")
        if not looks.where("look <> 'other'").isEmpty():
            return True
        texts = tree.read_texts(listed.join(looks, "path", "left_semi"), self.root)
        return not sync.file_status(self._table("files").join(looks, "path", "left_semi"), texts).where("status <> 'unchanged'").isEmpty()

    def sync_if_dirty(self) -> dict[str, int]:
        return self.sync() if self.is_dirty() else {}

    # --- queries

    def search_nodes(self, query: str, limit: int = 10, kinds=(), languages=()) -> DataFrame:
        vectors = self.embeddings
        vector = embed.embed_one(query, self.model) if vectors is not None else None
        return search.tiered(self.nodes, query, limit, kinds, languages, vectors, vector, ORDER, self.text)

    def search_by_signature(self, query: str, limit: int = 10, kinds=("function", "method")) -> DataFrame:
        return search.by_signature(self.nodes, query, kinds, limit, ORDER)

    def symbol(self, name: str, kind: str | None = None) -> str | None:
        """The id of the best match of a name."""
        row = self.search_nodes(name, 5, (kind,) if kind else ()).select("id").head()
        return row["id"] if row else None

    def callers(self, node_id: str, limit: int = 20, distinct: bool = False) -> DataFrame:
        return reads.callers(self.nodes, self.edges, node_id, limit, distinct, ORDER)

    def callees(self, node_id: str, limit: int = 20, distinct: bool = False) -> DataFrame:
        return reads.callees(self.nodes, self.edges, node_id, limit, distinct, ORDER)

    def impact_radius(self, node_id: str, depth: int = 2) -> DataFrame:
        return traversal.impact_radius(self.nodes, self.edges, node_id, depth)

    def call_graph(self, node_id: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        return traversal.call_graph(self.nodes, self.edges, node_id, depth)

    def subgraph(self, node_id: str, **how) -> tuple[DataFrame, DataFrame]:
        return traversal.subgraph(self.nodes, self.edges, node_id, **how)

    def type_hierarchy(self, node_id: str, direction: str = "both") -> DataFrame:
        return traversal.type_hierarchy(self.nodes, self.edges, node_id, direction)

    def find_path(self, start: str, end: str, max_depth: int = 10) -> DataFrame:
        """The nodes of a shortest path, in order, with the edge that leads to each."""
        path = traversal.shortest_path(self.edges, start, end, max_depth).select("pos", "id", F.col("kind").alias("via"))
        return self.nodes.join(path, "id").orderBy("pos")

    def path_edges(self, path: DataFrame) -> DataFrame:
        """Every edge that touches a node of a path, be it on the path or not."""
        return traversal.path_neighbourhood(self.edges, path)

    def build_context(self, task: str, max_nodes: int = 20, include_code: bool = True) -> context.TaskContext:
        vectors = self.embeddings
        vector = embed.embed_one(task, self.model) if vectors is not None else None
        return context.build_context(self.nodes, self.edges, task, max_nodes, self.sources if include_code else None, vectors, vector, self.text)

    def explore(self, query: str, budget: str = "medium") -> str:
        vectors = self.embeddings
        vector = embed.embed_one(query, self.model) if vectors is not None else None
        return context.explore(self.nodes, self.edges, self.sources, query, budget, vectors, vector, self.text)

    def node(self, node_id: str) -> DataFrame:
        return reads.node_by_id(self.nodes, node_id)

    def node_source(self, node_id: str) -> str | None:
        row = context.with_code(self.node(node_id), self.sources).select("code").first()
        return row["code"] if row else None

    def dead_code(self, limit: int = 50) -> DataFrame:
        return reads.dead_nodes(self.nodes, self.edges, limit=limit, order=ORDER)

    def circular_dependencies(self) -> DataFrame:
        return cycles.circular_dependencies(self.nodes, self.edges)

    def stats(self) -> dict:
        """Counts, counts by kind and language (a few rows each), and bytes on disk."""
        whole = reads.counts(self._table("files"), self.nodes, self.edges).first().asDict()
        for column in ("kind", "language"):
            whole[f"by_{column}"] = {r[column]: r["n"] for r in reads.count_by(self.nodes, column).collect()}
        return whole | {"bytes": self.store.size()}


class OpenGraphs:
    """The graphs that were used last, at most ``most``."""

    def __init__(self, spark: SparkSession, most: int = 10):
        self.spark, self.most, self.graphs = spark, most, OrderedDict()

    def get(self, root: str) -> CodeGraph:
        if root not in self.graphs:
            self.graphs[root] = CodeGraph.open(self.spark, root)
            if len(self.graphs) > self.most:
                self.graphs.popitem(last=False)
        self.graphs.move_to_end(root)
        return self.graphs[root]
