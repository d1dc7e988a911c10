"""Measured queries: how long a result took, its rows and the files that it covers, from the run that made it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Measure:
    query: str
    millis: float
    rows: int
    files: int


def observed(df: DataFrame, file_col: str = "file_path", exact: bool = True) -> tuple[DataFrame, Observation]:
    """``df``, and what its next action tells: ``rows`` and ``files``, the distinct values of a column.

    They are gathered as the rows pass, so there is no second pass.  ``exact`` holds the distinct values, as befits an answer
    of bounded length; without it their number is estimated within five parts of a hundred.
    """
    seen = Observation()
    files = F.size(F.collect_set(file_col)) if exact else F.approx_count_distinct(file_col)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), files.cast("long").alias("files")), seen


def measured(name: str, ask: Callable[[], DataFrame], file_col: str = "file_path", exact: bool = True) -> Measure:
    """Runs a query once, all its rows computed and discarded; the time includes planning it."""
    began = time.perf_counter()
    df, seen = observed(ask(), file_col, exact)
    df.write.format("noop").mode("overwrite").save()
    said = seen.get
    return Measure(name, 1000 * (time.perf_counter() - began), said["rows"], said["files"])


def profile(queries: dict[str, Callable[[], DataFrame]], repeat: int = 1, file_col: str = "file_path") -> tuple[list[Measure], float]:
    """A measure for each query, of the last of its runs, and the mean time of all runs in milliseconds."""
    runs = [measured(name, ask, file_col) for name, ask in queries.items() for _ in range(repeat)]
    return runs[repeat - 1 :: repeat], sum(r.millis for r in runs) / max(1, len(runs))
