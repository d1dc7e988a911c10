"""Embeddings of nodes by a pluggable model.

A model is a function that, called once in each Python worker, returns a function of a list of texts to an array of
vectors.  The default needs no files: it hashes words and letter trigrams into a fixed number of signed buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_model(dimensions: int = 256) -> Model:
    def load():
        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions), np.float32)
            for row, text in zip(out, texts, strict=True):
                for word in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", text):
                    low = word.lower()
                    for piece, weight in [(low, 1.0), *[(f"{low[i : i + 3]}~", 0.3) for i in range(len(low) - 2)]]:
                        h = zlib.crc32(piece.encode())
                        row[h % dimensions] += weight if h >> 31 else -weight
            return out

        return embed

    return load


def node_text() -> Column:
    """What stands for a node: its qualified name or name, docstring and signature."""
    return F.concat_ws(" ", F.coalesce("qualified_name", "name"), "docstring", "signature")


def embed_texts(rows: DataFrame, id_col: str, text: Column, model: Model, batch: int = 32) -> DataFrame:
    """(node_id, embedding): unit vectors, in batches; the model is loaded once a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = model()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                vectors = np.asarray(embed(part.column(1).to_pylist()), np.float32)
                vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], ["node_id", "embedding"])

    return rows.select(F.col(id_col).alias("node_id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "node_id string, embedding array<float>")


def embed_one(text: str, model: Model) -> list[float]:
    v = np.asarray(model()([text]), np.float32)[0]
    return (v / max(float(np.linalg.norm(v)), 1e-12)).tolist()
