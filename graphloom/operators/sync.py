"""Incremental maintenance: what changed between snapshots, and tables without what went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schemas import EMBEDDABLE

FINGERPRINT = ("name", "qualified_name", "signature", "docstring")


def file_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, old_hash, new_hash) of (path, content_hash) snapshots: added, removed, modified or unchanged."""
    a = old.select(F.col("path").alias("_old"), F.col("content_hash").alias("old_hash"))
    b = new.select(F.col("path").alias("_new"), F.col("content_hash").alias("new_hash"))
    both = a.join(b, F.col("_old") == F.col("_new"), "full_outer")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return both.select(F.coalesce("_old", "_new").alias("path"), status.alias("status"), "old_hash", "new_hash")


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of the rows with its keys; of several new rows with a key, the largest by its other columns in turn."""
    rest = [c for c in new.columns if c not in keys]
    if rest:
        last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_last")).select(*keys, "_last.*").select(*new.columns)
    else:
        last = new.distinct()
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, incoming: bool, embeddings: DataFrame | None = None) -> tuple:
    """Nodes, edges and embeddings without those of ``files`` (path); with ``incoming`` also without edges that lead there."""
    gone = nodes.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    kept_nodes = nodes.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").select(*nodes.columns)
    for end in ["source", "target"][: 1 + incoming]:
        edges = edges.join(gone, F.col(end) == F.col("id"), "left_anti")
    if embeddings is not None:
        embeddings = embeddings.join(gone, F.col("node_id") == F.col("id"), "left_anti")
    return kept_nodes, edges, embeddings


def stale_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id) of old nodes that are gone or whose fingerprint changed."""
    mark = lambda: F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in FINGERPRINT])
    a = old.select("id", mark().alias("_a"))
    b = new.select(F.col("id").alias("_id"), mark().alias("_b"))
    return a.join(b, F.col("id") == F.col("_id"), "left").where("_id is null or _a <> _b").select("id")


def missing_embeddings(nodes: DataFrame, embeddings: DataFrame, kinds: tuple[str, ...] = EMBEDDABLE) -> DataFrame:
    """Nodes of the kinds that have no embedding."""
    return nodes.where(F.col("kind").isin(*kinds)).join(embeddings.select("node_id"), F.col("id") == F.col("node_id"), "left_anti")
