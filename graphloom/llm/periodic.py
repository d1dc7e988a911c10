"""Periodic runs of words: stretches that repeat one sequence of words at least three times, by heavy and light lag counting.

A lag is a distance between words.  For each lag the number of equal words at that distance is counted exactly: words that are
frequent in a text by one Fourier autocorrelation of their places, rare ones by the differences of their places.  A run of period
q needs 2q equal words in a row at lag q, so only lags with enough of them are scanned for islands, and such a scan looks at one
place in each stretch of that length first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import GAP, slices, text_or_empty

#: Pairs of places that are held at a time.
PAIRS = 1 << 20


def lag_counts(ids: np.ndarray, most: int, heavy: int) -> np.ndarray:
    """How many words equal the word ``lag`` places on, for each lag up to ``most``; words with more than ``heavy`` places are
    counted by Fourier transform, the others pair by pair."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    times = np.bincount(ids)
    counts = np.zeros(most + 1, np.int64)
    often = np.flatnonzero(times > heavy)
    if len(often):
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        ends = np.cumsum(times)
        for w in often:
            places = np.zeros(size)
            places[order[ends[w] - times[w] : ends[w]]] = 1
            power += np.abs(np.fft.rfft(places)) ** 2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    rare = order[times[ids[order]] <= heavy]
    # Places of a word stand together and in order; a place's partners are those up to ``most`` further on.
    key = ids[rare].astype(np.int64) * (n + most + 1) + rare
    partners = np.searchsorted(key, key + most, side="right") - np.arange(len(key)) - 1
    total = np.cumsum(partners)
    start = 0
    while start < len(key):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        own = partners[start:end]
        left = np.repeat(np.arange(start, end), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(total[start:end] - own - done, own)
        counts += np.bincount(rare[right] - rare[left], minlength=most + 1)
        start = end
    counts[0] = 0
    return counts


def _matching(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first place from ``at`` on, in the direction of ``step``, whose word differs from the one ``lag`` places on."""
    end, width = len(ids) - lag if step > 0 else -1, 16
    while at != end:
        width = min(2 * width, abs(end - at))
        a, b = (at, at + width) if step > 0 else (at - width + 1, at + 1)
        differs = np.flatnonzero(ids[a:b] != ids[a + lag : b + lag])
        if len(differs):
            return a + int(differs[0] if step > 0 else differs[-1])
        at += step * width
    return end


def islands(ids: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, number) of each stretch of at least ``least`` places whose words equal those ``lag`` places on."""
    last = len(ids) - lag
    same = lambda x: (x >= 0) & (x < last) & (ids[np.clip(x, 0, last - 1)] == ids[np.clip(x, 0, last - 1) + lag])
    seeds = np.arange(0, last, least)  # an island holds a multiple of its least length
    seeds = seeds[ids[seeds] == ids[seeds + lag]]
    for j in range(1, min(4, (least - 1) // 2) + 1):  # and half of it on one side of that place
        if len(seeds) < 8:
            break
        if j == 1:
            right = left = np.ones(len(seeds), bool)
        right, left = right & same(seeds + j), left & same(seeds - j)
        keep = right | left
        seeds, right, left = seeds[keep], right[keep], left[keep]
    end = -1
    for t in seeds.tolist():
        if t > end:
            start, end = _matching(ids, t, lag, -1) + 1, _matching(ids, t, lag, 1)
            if end - start >= least:
                yield start, end - start


def runs_of(ids: np.ndarray, least_length: int = 24, least_times: int = 3, heavy: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers from 0, by start, then period.

    A run is a stretch with smallest period q, at least ``least_length`` and ``least_times`` (2 or more) times q long, that
    neither neighbour extends.
    """
    n = len(ids)
    most = n // least_times
    if n < least_length or not most:
        return []
    heavy = heavy if heavy is not None else max(16, int((n * n.bit_length()) ** 0.5))
    counts = lag_counts(ids, most, heavy)
    lags = np.arange(most + 1)
    needed = np.maximum(np.maximum(least_length - lags, (least_times - 1) * lags), 1)
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(counts >= needed).tolist():
        if q and counts[q] >= needed[q]:
            for start, number in islands(ids, q, int(needed[q])):
                if (start, number + q) not in found:  # else its smallest period divides q
                    found[start, number + q] = q
                    # What a run adds to the multiples of its period is no other run's: two such stretches share less than
                    # the larger period, by the theorem of Fine and Wilf.
                    if least_times >= 2:
                        more = np.arange(2 * q, min(number + q - 1, most) + 1, q)
                        counts[more] -= number + q - more
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


SCHEMA = "_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, text binary"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 24, least_times: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, ``runs`` by start and period in word numbers from 0, and ``text`` without repeats.

    Words are maximal runs of other characters than ASCII white space; ``text`` holds the words that stay, joined by a space.
    Null texts count as empty: no run, empty text.  Null and repeated ids and repeated rows change nothing, each row is
    judged alone, whole and of any length: work follows n^1.5 at most in the counts and n log n in the scans of ordinary text,
    and pairs of places are held a block at a time.  Of stretches with several periods the smallest counts; runs of different
    periods may overlap.  An empty table gives no row.  Other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                runs, texts = [], []
                for text in part.column(1).to_pylist():
                    words = text.split()  # bytes are split at ASCII white space
                    number: dict[bytes, int] = {}
                    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                    found = runs_of(ids, least_length, least_times)
                    if found:
                        words = [words[i] for i in np.flatnonzero(collapsed(len(words), found)).tolist()]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    texts.append(b" ".join(words))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array(texts, pa.binary())], ["_id", "runs", "text"])

    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).cast("binary").alias("_text"))
    out = rows.mapInArrow(find, SCHEMA.format(kind=rows.schema["_id"].dataType.simpleString()))
    return out.select(F.col("_id").alias(id_col), "runs", F.col("text").cast("string").alias("text"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text), where a tenth of the documents, by the checksum of their ids, repeat their words from some place on.

    Let h be the checksum and g = h div 10.  Where h ends in 0 and there are n > 0 words, word i >= a becomes word
    a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8).  Rows with a null id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    g = F.floor(h / 10)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), g.alias("_g"), chosen.alias("_chosen"))
    rows = rows.withColumn("_words", F.when(F.col("_chosen"), words_of(F.col("_text")))).withColumn("_n", F.size("_words"))
    a = (F.col("_g") % F.col("_n")).cast("int")
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, a)).withColumn("_left", F.col("_n") - F.col("_a"))
    p = (1 + F.floor(F.col("_left") / (3 + F.col("_g") % 8))).cast("int")
    rows = rows.withColumn("_p", p)
    block = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil(F.col("_left") / F.col("_p")).cast("int"))), F.lit(1), F.col("_left"))
    planted = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), " ")
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_chosen") & (F.col("_n") > 0), planted).otherwise(F.col("_text")).alias(text_col))
