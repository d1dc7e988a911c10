"""What several operators share: table access, the shared folder, and tables that cut lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import shared_folder, written

__all__ = ["GAP", "WORD", "Lookup", "shared_folder", "slices", "table", "text_or_empty", "written"]

#: Words everywhere are maximal runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes in its second column, so that memory doesn't follow the batch."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def places_of(array: pa.Array) -> np.ndarray:
    """Where the values of a string or binary array begin and end in its data."""
    if not len(array):
        return np.zeros(1, np.int32)
    return np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]


def data_of(array: pa.Array) -> bytes | memoryview:
    return memoryview(data) if len(array) and (data := array.buffers()[2]) else b""


class Lookup:
    """Byte strings by string, found by the batch in an Arrow table; ``learn`` gives those of new strings, and the table is
    emptied when it reaches ``most`` strings or ``most_bytes`` bytes."""

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]], most: int, most_bytes: int = 64 << 20):
        self.learn, self.most, self.most_bytes = learn, most, most_bytes
        self.forget()

    def forget(self) -> None:
        # The empty key is always there.
        self.keys, self.values = pa.array([""], pa.string()), pa.array([b""], pa.binary())

    def take(self, keys: pa.Array) -> pa.Array:
        """The value of each key; that of the empty key is empty."""
        at = pc.index_in(keys, value_set=self.keys)
        if at.null_count:
            unknown = at.is_null()
            missed = keys.filter(unknown)
            new = missed.unique()
            data, cuts = bytes(data_of(new)), places_of(new).tolist()
            values = pa.array(self.learn([data[a:b] for a, b in zip(cuts, cuts[1:])]), pa.binary())
            at = pc.replace_with_mask(at, unknown, pc.add(pc.index_in(missed, value_set=new), pa.scalar(len(self.keys), pa.int32())))
            self.keys, self.values = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.values, values])
        out = self.values.take(at)
        if len(self) > self.most or self.keys.nbytes + self.values.nbytes > self.most_bytes:
            self.forget()
        return out

    def __len__(self) -> int:
        return len(self.keys) - 1
