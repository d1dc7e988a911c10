"""Search operators over nodes: exact, substring, signature, full-text, nearest vectors, and tiers of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import contains_like, matches_terms, query_terms, searchable
from graphloom.functions.vectors import l2_distance
from graphloom.operators.reads import one_of
from graphloom.operators.textindex import TextIndex

TEXT_COLUMNS = ("name", "qualified_name", "docstring", "signature")
SCORES = {"exact": 1.0, "text": 0.8, "like": 0.5}


def _first(nodes: DataFrame, hit: Column, kinds, languages, limit, order) -> DataFrame:
    out = one_of(one_of(nodes.where(hit), "kind", kinds), "language", languages)
    return out.orderBy(*order).limit(limit) if limit else out


def by_name(nodes: DataFrame, name: str, kinds=(), languages=(), limit: int | None = 20, order=("id",)) -> DataFrame:
    return _first(nodes, F.col("name") == name, kinds, languages, limit, order)


def by_like(nodes: DataFrame, query: str, kinds=(), languages=(), limit: int | None = 20, order=("id",), column: str = "name") -> DataFrame:
    return _first(nodes, contains_like(F.col(column), query), kinds, languages, limit, order)


def by_text(nodes: DataFrame, query: str, kinds=(), languages=(), limit: int | None = 20, order=("id",), index: TextIndex | None = None) -> DataFrame:
    """Nodes in whose text columns every term occurs, the last as a prefix.  Not ranked.

    With a stored ``index`` over the nodes' texts these are not read; what ``nodes`` lacks is not found.
    """
    if index is not None:
        return _first(nodes.join(index.search(query), "id", "left_semi"), F.lit(True), kinds, languages, limit, order)
    columns = [F.col(c) for c in TEXT_COLUMNS if c in nodes.columns]
    return _first(nodes, matches_terms(columns, query), kinds, languages, limit, order)


def signature_parts(query: str) -> list[str]:
    """Parameter types, split at commas, and the return type behind the first arrow."""
    head, arrow, tail = query.partition("->")
    return [p for p in map(str.strip, [*head.split(","), *([tail] if arrow else [])]) if p]


def by_signature(nodes: DataFrame, query: str, kinds=(), limit: int | None = 20, order=("id",)) -> DataFrame:
    """Nodes whose signature has every part somewhere; the score is 1."""
    hit = F.col("signature").isNotNull()
    for part in signature_parts(query):
        hit = hit & contains_like(F.col("signature"), part)
    return _first(nodes, hit, kinds, (), limit, order).withColumn("score", F.lit(1.0))


def nearest(vectors: DataFrame, query: list[float], k: int = 20, id_col: str = "id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(id, distance): the k vectors nearest to one, by distance rounded to ``digits`` places and id: a top-k, no sort."""
    to = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col).alias("id"), F.round(l2_distance(F.col(vector_col), to), digits).alias("distance")).orderBy("distance", "id").limit(k)


def by_vector(nodes: DataFrame, vectors: DataFrame, query: list[float], k: int = 20, kinds=(), languages=(), id_col: str = "node_id") -> DataFrame:
    """The k nearest nodes; kinds and languages filter afterwards, so fewer may remain."""
    near = nearest(vectors, query, k, id_col)
    return one_of(one_of(nodes.join(near, "id"), "kind", kinds), "language", languages).withColumn("score", F.greatest(F.lit(0.0), 1 / (1 + F.col("distance")) - 0.05))


def postings(nodes: DataFrame) -> DataFrame:
    """(token, id): an inverted index of the text columns, for graphs that are searched often; write it bucketed by token."""
    tokens = F.array_distinct(F.flatten(F.array(*[F.filter(F.split(searchable(F.col(c)), " "), lambda t: t != "") for c in TEXT_COLUMNS if c in nodes.columns])))
    return nodes.select(F.explode(tokens).alias("token"), "id")


def by_postings(index: DataFrame, query: str) -> DataFrame:
    """(id) of nodes that have every token of a query, the last as a prefix; phrases are searched as their tokens."""
    tokens = [t for term in query_terms(query) for t in term.split()]
    if not tokens:
        return index.select("id").limit(0)
    hit = F.col("token").startswith(tokens[-1])
    for t in tokens[:-1]:
        hit = hit | (F.col("token") == t)
    exact = sorted(set(tokens[:-1]))
    found = index.where(hit).groupBy("id").agg(F.count_distinct(F.when(F.col("token").isin(*exact) if exact else F.lit(False), F.col("token"))).alias("_n"), F.max(F.col("token").startswith(tokens[-1])).alias("_p"))
    return found.where((F.col("_n") == len(exact)) & F.col("_p")).select("id")


def merge_tiers(tiers: list[tuple[float | None, DataFrame]], limit: int, order=("id",)) -> DataFrame:
    """One ranked list: earlier tiers first, each in its order, every id at its first tier, ``limit`` rows.

    A tier is (score, rows), or (None, rows) with a score column of its own, which then orders it.  Each tier is cut to
    ``limit`` rows before the windows, so these see at most tiers x limit rows.
    """
    parts = []
    for t, (score, rows) in enumerate(tiers):
        by = [F.desc("score"), *order] if score is None else list(order)
        some = rows if score is None else rows.withColumn("score", F.lit(score))
        some = some.orderBy(*by).limit(limit)
        parts.append(some.withColumn("tier", F.lit(t)).withColumn("tier_rank", F.row_number().over(Window.orderBy(*by))))
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    once = whole.withColumn("_seen", F.row_number().over(Window.partitionBy("id").orderBy("tier", "tier_rank"))).where("_seen = 1")
    return once.orderBy("tier", "tier_rank").limit(limit).drop("_seen")


def tiered(nodes: DataFrame, query: str, limit: int = 10, kinds=(), languages=(), vectors: DataFrame | None = None, vector: list[float] | None = None, order=("id",), index: TextIndex | None = None) -> DataFrame:
    """Exact names, full text, nearest vectors, then substrings of names, as one ranked union."""
    cols = [c for c in nodes.columns]
    tiers = [(SCORES["exact"], by_name(nodes, query, kinds, languages, limit, order)), (SCORES["text"], by_text(nodes, query, kinds, languages, limit, order, index))]
    if vectors is not None and vector is not None:
        tiers.append((None, by_vector(nodes, vectors, vector, limit, kinds, languages).select(*cols, "score")))
    tiers.append((SCORES["like"], by_like(nodes, query, kinds, languages, limit, order)))
    return merge_tiers(tiers, limit, order)
