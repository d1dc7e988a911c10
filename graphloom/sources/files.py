"""Extraction of source texts into the tables of a graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.extract import NODE_FIELDS, extract
from graphloom.storage import written


_NODE = pa.struct([(n, pa.bool_() if n.startswith("is_") else pa.int32() if n.endswith(("line", "column")) else pa.string()) for n in NODE_FIELDS])
_EDGE = pa.struct([("source", pa.string()), ("target", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("column", pa.int32())])
_REF = pa.struct([("source_id", pa.string()), ("ref_name", pa.string()), ("ref_kind", pa.string()), ("file_path", pa.string()), ("line", pa.int32()), ("column", pa.int32())])
_IMPORT = pa.struct([(n, pa.string()) for n in ("file_path", "language", "local", "original", "module")])
_SQL = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}


def _ddl(struct: pa.StructType) -> str:
    return "array<struct<" + ",".join(f"`{f.name}`:{_SQL[f.type]}" for f in struct) + ">>"


@dataclass
class Extracted:
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame
    imports: DataFrame
    errors: DataFrame


def extract_all(texts: DataFrame) -> Extracted:
    """The tables of (path, language, content_hash, text): one pass of the parsers, written once, then exploded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [extract(p, t, lang) for p, lang, t in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x.nodes for x in done], pa.list_(_NODE)), pa.array([x.edges for x in done], pa.list_(_EDGE)), pa.array([x.refs for x in done], pa.list_(_REF)), pa.array([x.imports for x in done], pa.list_(_IMPORT)), pa.array([x.error for x in done], pa.string())],
                ["path", "language", "content_hash", "nodes", "edges", "refs", "imports", "error"],
            )

    schema = f"path string, language string, content_hash string, nodes {_ddl(_NODE)}, edges {_ddl(_EDGE)}, refs {_ddl(_REF)}, imports {_ddl(_IMPORT)}, error string"
    parsed = written(texts.select("path", "language", "content_hash", "text").mapInArrow(run, schema), "extracted")
    now = F.unix_millis(F.current_timestamp())
    files = parsed.select("path", "content_hash", "language", now.alias("last_indexed"), F.size("nodes").alias("node_count"))
    return Extracted(files, parsed.select(F.inline("nodes")).withColumn("updated_at", now), parsed.select(F.inline("edges")), parsed.select(F.inline("refs")), parsed.select(F.inline("imports")), parsed.where("error is not null").select("path", "error"))
