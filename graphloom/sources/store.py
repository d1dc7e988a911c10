"""A graph's tables on disk: parts by bucket, and manifests that say which parts are current.

Every table has a path column, and a row stands in the bucket of its path's hash.  A commit writes the buckets that changed
into a part of its own and a manifest that lists, for each table and bucket, the part to read; other buckets keep theirs.
Readers see the tables of one manifest, never a mixture.  A manifest has one successor, so a writer that started from an older
state is told so.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.schemas import EMBEDDINGS, EXCLUDE, EXTENSIONS, MAX_FILE_SIZE
from graphloom.sources.manifests import Manifests

#: The path that a table's rows belong to, and how they are ordered in a file, so that filters on it skip row groups.
PATH_OF = {"files": "path", "sources": "path"}
ORDER_OF = {"nodes": ["name"], "edges": ["kind", "source"], "refs": ["ref_name"]}
#: Bytes of source text for each bucket, and the fewest buckets.
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 8


@dataclass
class Config:
    version: int = 1
    languages: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    max_file_size: int = MAX_FILE_SIZE
    embed_symbols: bool = True
    embedding_dimensions: int = 256
    embedding_batch_size: int = 32


class Store:
    """States under a path that Spark can write, local or not; the last ``keep`` stay readable."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.manifests = Manifests(spark, self.path)

    @contextmanager
    def lock(self, stale_s: float = 3600, beat_s: float = 60) -> Iterator[None]:
        """Held by one writer at a time, whose heart beats, so that a long run isn't taken for a lost one."""
        with self.manifests.lock(stale_s):
            done = threading.Event()

            def beat() -> None:
                while not done.wait(beat_s):
                    self.manifests.touch(".lock")

            heart = threading.Thread(target=beat, daemon=True)
            heart.start()
            try:
                yield
            finally:
                done.set()
                heart.join()

    def exists(self) -> bool:
        return bool(self.manifests.numbers())

    def config(self) -> Config:
        known = Config().__dict__
        return Config(**{k: v for k, v in (self.manifests.read("config.json") or {}).items() if k in known})

    def save_config(self, config: Config) -> None:
        self.manifests.write("config.json", asdict(config))

    def version(self) -> int:
        return self.manifests.version()

    def state(self, version: int | None = None) -> dict:
        return self.manifests.manifest(version)

    @staticmethod
    def bucket_of(path: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")

    def table(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame | None:
        """A table, or some of its buckets; none if the state has no such table."""
        parts = self.state(version).get("tables", {}).get(name)
        if parts is None:
            return None
        chosen = parts["parts"] if buckets is None else {str(b): parts["parts"][str(b)] for b in buckets if str(b) in parts["parts"]}
        schema = T.StructType.fromJson(parts["schema"])
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{part}/_bucket={b}" for b, part in chosen.items()])

    def commit(self, tables: dict[str, tuple[DataFrame, Iterable[int] | None]], buckets: int | None = None, after: int | None = None, **more: object) -> int:
        """The next state: for each table its rows, and the buckets that they are all of (None: all buckets).

        Tables that aren't named stay, unless ``buckets`` deals everything anew.  ``after`` is the state that the rows
        were made from; Conflict if it isn't the current one.
        """
        after = self.version() if after is None else after
        old = self.state(after) if after else {}
        new = {k: v for k, v in old.items() if k != "tables"} | {"schema_version": 3, "buckets": buckets or old.get("buckets", LEAST_BUCKETS)} | more
        new["tables"] = {} if buckets else dict(old.get("tables", {}))
        for name, (df, touched) in tables.items():
            part = f"part-{uuid.uuid4().hex}"
            count = len(set(touched)) if touched is not None else new["buckets"]
            rows = df.withColumn("_bucket", self.bucket_of(F.col(PATH_OF.get(name, "file_path")), new["buckets"]))
            # A bucket's rows are one task's, of about BUCKET_BYTES of source text.
            rows = rows.repartition(max(1, count), "_bucket").sortWithinPartitions("_bucket", *ORDER_OF.get(name, []))
            rows.write.partitionBy("_bucket").parquet(f"{self.path}/{name}/{part}")
            kept = {} if touched is None else {b: p for b, p in new["tables"].get(name, {"parts": {}})["parts"].items() if int(b) not in set(touched)}
            written = {b.removeprefix("_bucket="): part for b in self.manifests.names(f"{name}/{part}") if b.startswith("_bucket=")}
            new["tables"][name] = {"schema": df.schema.jsonValue(), "parts": kept | written}
        version = self.manifests.commit(new, after)
        self._forget(version)
        return version

    def _forget(self, version: int) -> None:
        """Remove states that are too old, and parts that no state left names."""
        for old in self.manifests.numbers():
            if old <= version - self.keep:
                self.manifests.forget(old)
        named = {f"{name}/{part}" for v in self.manifests.numbers() for name, t in self.state(v).get("tables", {}).items() for part in t["parts"].values()}
        for name in self.state(version).get("tables", {}):
            for part in self.manifests.names(name):
                if part.startswith("part-") and f"{name}/{part}" not in named:
                    self.manifests.delete(f"{name}/{part}")

    def clear(self) -> None:
        self.commit({}, buckets=LEAST_BUCKETS)

    def size(self) -> int:
        """Bytes of the current state's tables; 0 if there are none."""
        return sum(self.manifests.bytes(f"{name}/{part}/_bucket={b}") for name, t in self.state().get("tables", {}).items() for b, part in t["parts"].items())


def empty(spark: SparkSession, schema: T.StructType = EMBEDDINGS) -> DataFrame:
    return spark.createDataFrame([], schema)
