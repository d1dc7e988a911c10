"""Graph views over relational tables: the same operators run on them as on a code graph.

A view gives nodes and edges with the columns that its operators read; Catalyst prunes the rest and pushes filters down to
the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.reads import prune_dangling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _only(df: DataFrame, kind: str, column: str, node_id: str | list[str] | None) -> DataFrame | None:
    """Rows whose vertex of a kind is ``node_id``, or one of them, by the bare key, which the scan can filter; None if none is
    of the kind."""
    if node_id is None:
        return df
    split = [x.partition(":") for x in ([node_id] if isinstance(node_id, str) else node_id)]
    keys = [F.lit(key).try_cast(df.schema[column].dataType) for its_kind, _, key in split if its_kind == kind and str(_number(key)) == key]
    return df.where(F.col(column).isin(*keys)) if keys else None


def _number(key: str) -> int | None:
    try:
        return int(key)
    except ValueError:
        return None


def _whole(parts: list[DataFrame | None], empty: str, spark: SparkSession) -> DataFrame:
    some = [p for p in parts if p is not None]
    return reduce(DataFrame.unionAll, some) if some else spark.createDataFrame([], empty)


def commerce_nodes(spark: SparkSession, sf_dir: str, node_id: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, name, file_path): regions, nations, customers, suppliers, parts, orders; file_path is what they belong to.

    With ``node_id`` only the table of its kind is read, and of it only row groups that may hold the key; with ``kinds`` only
    the tables of these.
    """
    plan = [
        ("region", "region", "r_regionkey", F.col("r_name"), F.lit("world")),
        ("nation", "nation", "n_nationkey", F.col("n_name"), _key("region", "n_regionkey")),
        ("customer", "customer", "c_custkey", F.col("c_name"), _key("nation", "c_nationkey")),
        ("supplier", "supplier", "s_suppkey", F.col("s_name"), _key("nation", "s_nationkey")),
        ("part", "part", "p_partkey", F.col("p_name"), F.col("p_brand")),
        ("orders", "order", "o_orderkey", F.col("o_orderpriority"), _key("customer", "o_custkey")),
    ]
    parts = []
    for source, kind, key, name, group in plan:
        if not kinds or kind in kinds:
            rows = _only(table(spark, sf_dir, source), kind, key, node_id)
            parts.append(None if rows is None else rows.select(_key(kind, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), group.alias("file_path")))
    return _whole(parts, "id string, kind string, name string, file_path string", spark)


def commerce_edges(spark: SparkSession, sf_dir: str, source: str | list[str] | None = None, target: str | list[str] | None = None, kinds: tuple[str, ...] = (), among: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, target, kind, line): containment, customers' orders (calls), the parts of orders (imports, one for each
    line item, so they repeat), and the suppliers of parts (extends).  With an end given, or several, only the tables that have edges
    of its kind are read, filtered by its key; with ``kinds`` only the tables of these.  ``among``: edges whose ends both are
    among the keys (id) of their kind, joined by the bare keys, which are shorter than ids."""
    none = F.lit(None).cast("int")
    get = lambda name: table(spark, sf_dir, name)
    items = get("lineitem")
    plan = [
        (get("nation"), ("region", "n_regionkey"), ("nation", "n_nationkey"), "contains", none),
        (get("customer"), ("nation", "c_nationkey"), ("customer", "c_custkey"), "contains", none),
        (get("supplier"), ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "contains", none),
        (get("orders"), ("customer", "o_custkey"), ("order", "o_orderkey"), "calls", none),
        (items, ("order", "l_orderkey"), ("part", "l_partkey"), "imports", F.col("l_linenumber")),
        (items, ("part", "l_partkey"), ("supplier", "l_suppkey"), "extends", none),
    ]
    parts = []
    for rows, a, b, kind, line in plan:
        rows = _only(rows, *a, source) if not kinds or kind in kinds else None
        rows = _only(rows, *b, target) if rows is not None else None
        if rows is not None and among is not None:
            rows = prune_dangling(rows.select(a[1], b[1], line.alias("_line")), among[a[0]], among[b[0]], (a[1], b[1]))
            line = F.col("_line")
        if rows is not None and kind == "extends":
            rows = rows.select(a[1], b[1]).distinct()
            line = none
        parts.append(None if rows is None else rows.select(_key(*a).alias("source"), _key(*b).alias("target"), F.lit(kind).alias("kind"), line.alias("line")))
    return _whole(parts, "source string, target string, kind string, line int", spark)


def commerce_keys(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """(id): the bare keys of each kind of node."""
    keys = {"region": ("region", "r_regionkey"), "nation": ("nation", "n_nationkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "order": ("orders", "o_orderkey")}
    return {kind: table(spark, sf_dir, name).select(F.col(key).alias("id")) for kind, (name, key) in keys.items()}


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return nations.select(F.col("n_nationkey").cast("string").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"), _key("region", "n_regionkey").alias("file_path"))


def trade_edges(spark: SparkSession, sf_dir: str, most: int = 2) -> DataFrame:
    """(source, target, kind, line): each supplier nation and the customer nations that take most line items from it."""
    get = lambda name: table(spark, sf_dir, name)
    lines = (
        get("lineitem").select("l_orderkey", "l_suppkey")
        .join(get("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(get("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(get("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    )
    pairs = lines.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    # One row per pair of nations, whatever the tables' size.
    top = pairs.withColumn("line", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("n"), "c_nationkey"))).where(F.col("line") <= most)
    return top.select(F.col("s_nationkey").cast("string").alias("source"), F.col("c_nationkey").cast("string").alias("target"), F.lit("imports").alias("kind"), "line")


def session_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, line): event types that follow each other for a user; line is how often."""
    events = table(spark, sf_dir, "events")
    then = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select(F.col("event_type").alias("source"), then.alias("target")).where("source <> target")
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).cast("int").alias("line")).select("source", "target", F.lit("imports").alias("kind"), "line")


HREF = 'href="([^"]*)"'


def web_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, line): the links of pages, in order."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select(_key("page", "page_id").alias("source"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "path"))
    return links.select("source", F.concat(F.lit("path:"), "path").alias("target"), F.lit("imports").alias("kind"), (F.col("pos") + 1).alias("line"))


def text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, name, docstring, signature, language, file_path): documents as nodes."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.format_string("doc:%08d", "doc_id").alias("id"), F.lit("document").alias("kind"), F.col("source").alias("name"), F.col("text").alias("docstring"), F.lit(None).cast("string").alias("signature"), F.col("lang").alias("language"), F.col("source").alias("file_path"))


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, embedding): vectors as nodes, whose kind is their label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("kind"), "embedding")
