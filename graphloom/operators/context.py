"""From a task in words to entry points, related nodes and their source text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import STOP_WORDS, line_slice, symbol_tokens_of
from graphloom.operators import search, traversal
from graphloom.operators.textindex import TextIndex
from graphloom.schemas import BUDGETS

FENCES = {"typescript": "ts", "javascript": "js", "python": "py", "go": "go", "rust": "rs", "java": "java", "c": "c", "cpp": "cpp", "csharp": "cs"}
MOST_CHARS = 15_000
TRUNCATED = "[output truncated]\n"


def entry_points(nodes: DataFrame, task: str, most: int, vectors: DataFrame | None = None, vector: list[float] | None = None, stop_words: tuple[str, ...] = STOP_WORDS, per_token: int = 5, index: TextIndex | None = None) -> DataFrame:
    """Ranked nodes for a task: exact names of its tokens, full text of all of it, nearest vectors, then substrings of the
    first token; columns of nodes, score, tier and tier_rank."""
    tokens = symbol_tokens_of(task, stop_words) or task.split()[:1]
    named = None
    for i, token in enumerate(tokens):
        part = search.by_name(nodes, token, limit=per_token).withColumn("_token", F.lit(i))
        named = part if named is None else named.unionByName(part)
    cols = nodes.columns
    tiers = [] if named is None else [(1.0, named)]
    tiers.append((0.8, search.by_text(nodes, task, limit=most, index=index).withColumn("_token", F.lit(0))))
    if vectors is not None and vector is not None:
        tiers.append((None, search.by_vector(nodes, vectors, vector, most).select(*cols, "score").withColumn("_token", F.lit(0))))
    if tokens:
        tiers.append((0.5, search.by_like(nodes, tokens[0], limit=most).withColumn("_token", F.lit(0))))
    return search.merge_tiers(tiers, most, ("_token", "id")).drop("_token")


def with_code(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes with the text of their lines; null for files and where ``sources`` (path, text) lacks the file."""
    text = sources.select(F.col("path").alias("_path"), F.col("text").alias("_text"))
    joined = nodes.join(text, F.col("file_path") == F.col("_path"), "left")
    code = F.when(F.col("kind") != "file", line_slice(F.col("_text"), F.col("start_line"), F.col("end_line")))
    return joined.withColumn("code", code).drop("_path", "_text")


@dataclass
class TaskContext:
    task: str
    entries: DataFrame
    related: DataFrame
    code: DataFrame | None

    def summary(self, most_related: int = 10) -> str:
        """Markdown of the entry points and the first related nodes; collects at most the context's own rows."""
        entries = self.entries.select("kind", "name", "file_path", "start_line").collect()
        if not entries:
            return f"No relevant symbols found for: {self.task}"
        lines = [f"## Context: {self.task}", "", "### Entry points", ""]
        lines += [f"- {r['kind']} `{r['name']}` ({r['file_path']}:{r['start_line']})" for r in entries]
        related = self.related.select("kind", "name", "file_path", "start_line").limit(most_related).collect()
        if related:
            lines += ["", "### Related", ""] + [f"- {r['kind']} `{r['name']}` ({r['file_path']}:{r['start_line']})" for r in related]
        return "\n".join(lines)


def build_context(nodes: DataFrame, edges: DataFrame, task: str, max_nodes: int = 20, sources: DataFrame | None = None, vectors: DataFrame | None = None, vector: list[float] | None = None, index: TextIndex | None = None) -> TaskContext:
    """Entry points, up to ``max_nodes`` together with what lies within two edges of them, and their code."""
    entries = entry_points(nodes, task, max_nodes, vectors, vector, index=index).drop("tier_rank", "tier")
    ranked = entries.collect()  # at most max_nodes rows
    spark = nodes.sparkSession
    entries = spark.createDataFrame(ranked, entries.schema)
    room = max_nodes - len(ranked)
    order = spark.createDataFrame([(r["id"], i) for i, r in enumerate(ranked)], "id string, entry int")
    related = traversal.expand(nodes, edges, order, room) if room > 0 and ranked else nodes.limit(0).withColumns({"entry": F.lit(0), "depth": F.lit(0)})
    code = None
    if sources is not None:
        code = with_code(entries.select(*nodes.columns).unionByName(related.select(*nodes.columns)), sources)
    return TaskContext(task, entries, related, code)


def truncated(text: str, most: int = MOST_CHARS) -> str:
    return text if len(text) <= most else TRUNCATED + text[:most]


def explore(nodes: DataFrame, edges: DataFrame, sources: DataFrame, query: str, budget: str = "medium", vectors: DataFrame | None = None, vector: list[float] | None = None, index: TextIndex | None = None) -> str:
    """Markdown for a question: entry points with their code, related nodes, and who uses whom among them."""
    context = build_context(nodes, edges, query, BUDGETS[budget], sources, vectors, vector, index)
    rows = context.code.select("id", "kind", "name", "file_path", "start_line", "end_line", "language", "signature", "code").collect()
    if not rows:
        return context.summary()
    entries = [r["id"] for r in context.entries.select("id").collect()]
    place = {i: n for n, i in enumerate([*entries, *[r["id"] for r in rows if r["id"] not in entries]])}
    rows.sort(key=lambda r: place[r["id"]])
    names = {r["id"]: r["name"] for r in rows}
    chosen = nodes.sparkSession.createDataFrame([(i, n) for i, n in place.items()], "id string, entry int")
    links = traversal.relationships(edges, chosen).collect()
    parts = [context.summary(), "", "### Source", ""]
    for r in rows:
        parts += [f"#### {r['kind']} `{r['name']}` ({r['file_path']}:{r['start_line']}-{r['end_line']})", f"```{FENCES.get(r['language'], '')}", r["code"] or "", "```", ""]
    if links:
        parts += ["### Relationships", ""] + sorted(f"- `{names[x['source']]}` calls `{names[x['target']]}`" for x in links)
    return truncated("\n".join(parts))
