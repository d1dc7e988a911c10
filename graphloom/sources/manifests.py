"""Numbered manifests beside a folder of tables: which state is current, and who may write the next one."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


class Manifests:
    """Small JSON files in a folder that Spark can write, local or not.

    A state becomes current when its manifest appears under the next number; no manifest is replaced, so readers see a whole
    state or the one before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)

    def bytes(self, name: str) -> int:
        return self._fs.getContentSummary(self.at(name)).getLength() if self.exists(name) else 0

    def names(self, name: str = "") -> list[str]:
        """What a folder holds."""
        return [x.getPath().getName() for x in self._fs.listStatus(self.at(name))] if self.exists(name) else []

    def touch(self, name: str) -> None:
        if self.exists(name):
            self._fs.setTimes(self.at(name), int(time.time() * 1000), -1)

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self.at(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write(self, name: str, content: dict) -> None:
        """By renaming a finished file into place."""
        part, final = self.at(f".{name}.{uuid.uuid4().hex}.part"), self.at(name)
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(content, indent=1).encode()))
        stream.close()
        if self._fs.exists(final):
            self._fs.delete(final, False)
        self._fs.rename(part, final)

    def numbers(self) -> list[int]:
        """Numbers of the states that have a manifest."""
        return sorted(int(m[1]) for n in self.names() if (m := re.fullmatch(r"manifest-([0-9]+)\.json", n)))

    def version(self) -> int:
        return max(self.numbers(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        return self.read(f"manifest-{self.version() if version is None else version}.json") or {}

    def commit(self, content: dict, after: int, stale_s: float = 3600) -> int:
        """Makes ``content`` the state after number ``after``; raises Conflict if that state has a successor already.

        The claim on a number is a file that can be created once; one that led to no manifest within ``stale_s`` seconds is
        a lost writer's and is taken over.
        """
        version, claim = after + 1, f".claim-{after + 1}"
        if self.version() < version and self._age(claim) > stale_s:
            self._fs.rename(self.at(claim), self.at(f"{claim}-{uuid.uuid4().hex}"))
        try:
            self._fs.create(self.at(claim), False).close()
        except Exception as e:
            raise Conflict(f"state {version} of {self.path} is another writer's") from e
        if self.version() >= version:
            raise Conflict(f"state {version} of {self.path} is another writer's")
        self.write(f"manifest-{version}.json", content)
        return version

    def _age(self, name: str) -> float:
        """Seconds since a file was written; less than any number of them if it isn't there."""
        return time.time() - self._fs.getFileStatus(self.at(name)).getModificationTime() / 1000 if self.exists(name) else float("-inf")

    def forget(self, version: int) -> None:
        for name in (f"manifest-{version}.json", f".claim-{version}"):
            self._fs.delete(self.at(name), False)

    @contextmanager
    def lock(self, stale_s: float = 3600) -> Iterator[None]:
        """Held by one writer at a time; another one's raises.  The lock holds its owner's token, and nobody else removes it.

        A lock that is older than ``stale_s`` counts as left behind: it is moved aside, which one late writer alone manages,
        and ``commit`` still tells apart two that believe they hold it.
        """
        at, token = self.at(".lock"), uuid.uuid4().hex
        if self._age(".lock") > stale_s:
            aside = self.at(f".lock-{token}")
            if self._fs.rename(at, aside):
                self._fs.delete(aside, False)
        try:
            stream = self._fs.create(at, False)
            stream.write(bytearray(json.dumps({"owner": token}).encode()))
            stream.close()
        except Exception as e:
            raise Conflict(f"another index or sync is writing to {self.path}") from e
        try:
            yield
        finally:
            if (self.read(".lock") or {}).get("owner") == token:
                self._fs.delete(at, False)
