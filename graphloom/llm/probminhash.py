"""Near-duplicates by ProbMinHash, banding and verification.

Each distinct shingle of a text sends points of a Poisson process whose rate is its weight, every point to a random
register; a register keeps its earliest point, and a shingle stops once its next point comes after the latest register.
Two texts agree in a register with the probability Jaccard similarity of their weighted shingles.  All weights are 1, for
which that is the Jaccard similarity of the sets, by which links are defined.  Bands of registers give buckets.  Whether a
pair of a bucket can be a link at all is told by parity sketches: bit h of a sketch is the parity of the number of
shingles that hash to h, so two sketches differ in at most as many bits as the sets differ in shingles, and a pair that
differs in too many is ruled out for certain.  What is left is compared on the whole shingle sets; links give classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import GAP, text_or_empty, written
from graphloom.operators.components import components

_MASK = np.uint64((1 << 50) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_hashed(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    bare = F.trim(F.regexp_replace(text, GAP, " "))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, " "), lambda w: F.xxhash64(w)))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words; a shorter text is one window."""
    words = words.astype(np.int64).view(np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return out


def sketch_bits(size: int) -> int:
    """Bits of the parity sketch of a set: the power of two from twice its size on, 512 at least."""
    return max(512, 1 << (2 * size - 1).bit_length()) if size else 512


def parity(element: np.ndarray, bits: int) -> bytes:
    """The parity sketch of hashed shingles, in ``bits`` bits; one of half as many is its two halves, xored."""
    return np.packbits(np.bincount((element & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def signatures(flat: np.ndarray, offsets: np.ndarray, width: int, registers: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """For each text, words flat[offsets[i]:offsets[i + 1]]: its registers, its number of distinct shingles, and its parity
    sketch.

    A shingle has weight 1 however often it occurs.  Texts without words have empty (0) registers and no shingle.
    """
    n = len(offsets) - 1
    parts = [shingles(flat[a:b], width) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    doc = np.repeat(np.arange(n, dtype=np.uint64), [len(p) for p in parts])
    keys = np.sort((doc << np.uint64(50)) | (np.concatenate(parts) & _MASK)) if n else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys = keys[first]
    doc = (keys >> np.uint64(50)).astype(np.int64)
    element = mixed(keys & _MASK)
    distinct = np.bincount(doc, minlength=n)
    ends = np.cumsum(distinct)
    sketches = [parity(element[b - d : b], sketch_bits(int(d))) for b, d in zip(ends.tolist(), distinct.tolist(), strict=True)]
    best = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    latest = np.full(n, np.inf)
    clock, step = np.zeros(len(keys)), 0
    while len(element):
        step += 1
        noise = mixed(element + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        clock = clock - np.log1p(-(noise >> np.uint64(11)).astype(float) * 2.0**-53)
        slot = doc * registers + (mixed(noise) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, clock)
        won = best[slot] == clock
        owner[slot[won]] = element[won]
        going = doc[np.concatenate(([True], doc[1:] != doc[:-1]))]
        latest[going] = best.reshape(n, registers)[going].max(axis=1)
        alive = clock < latest[doc]
        element, doc, clock = element[alive], doc[alive], clock[alive]
    return owner.reshape(n, registers), distinct, sketches


def bands_of(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(registers), 1))
    for j in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + registers[:, j::rows][:, :bands])
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same) if len(a) + len(b) else 0.0


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    return np.unique(shingles(words, width) & _MASK)


def _sign(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                words = part.column(2)
                offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
                flat = words.flatten().to_numpy(zero_copy_only=False)
                registers, distinct, sketches = signatures(flat, offsets, width, bands * rows)
                keys = bands_of(registers, bands, rows)
                lists = [k if d else None for k, d in zip(keys, distinct, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64())), pa.array(distinct, pa.int32()), pa.array(sketches, pa.binary())], ["id", "same", "bands", "size", "sketch"])

    return run


def _verify(width: int, least: float):
    def run(batches):
        leader, own = None, None
        for batch in batches:
            keep = []
            ids, leaders = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a, b = batch.column(2), batch.column(3)
            for i, lead in enumerate(leaders):
                if own is None or lead != leader:
                    leader, own = lead, shingle_set(b[i].values.to_numpy(zero_copy_only=False), width)
                keep.append(jaccard(shingle_set(a[i].values.to_numpy(zero_copy_only=False), width), own))
            sims = np.array(keep)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaders, pa.int64()), pa.array(sims, pa.float64())], ["id", "leader", "similarity"])

    return run


def connected(links: DataFrame, left: str, right: str, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node that links lead to, for every node that has a link; ``labels`` is what links that were
    found earlier gave.

    Links are drawn between the labels of their ends, so those that gave ``labels`` are not walked again.  Components shrink to
    stars, so a round reads no more links than the one before.
    """
    ends = links.select(F.col(left).alias("source"), F.col(right).alias("target"))
    if labels is None:
        return written(components(ends).toDF("node", "label"), "labels")
    known = ends.join(labels.toDF("source", "_s"), "source", "left").join(labels.toDF("target", "_t"), "target", "left")
    between = written(known.select(F.coalesce("_s", "source").alias("source"), F.coalesce("_t", "target").alias("target")), "between")
    own = labels
    for end in between.columns:
        own = own.unionByName(between.select(F.col(end).alias("node"), F.col(end).alias("label")))
    # Written, so that a join by the label of a large class can be split.
    moved = written(components(between).toDF("label", "_to"), "moved")
    return written(own.distinct().join(moved, "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")


class Members:
    """Some rows of a bucket: labels, reps, sizes, and sketches by their number of bits."""

    def __init__(self, labels: bytes, reps: bytes, sizes: bytes, sketches: bytes):
        self.labels, self.reps, self.sizes = np.frombuffer(labels, np.int64), np.frombuffer(reps, np.int64), np.frombuffer(sizes, np.int32)
        bits = np.array([sketch_bits(n) for n in self.sizes.tolist()], np.int64)
        at = np.cumsum(bits // 8) - bits // 8
        data = np.frombuffer(sketches, np.uint8)
        self.by_bits = {}
        for b in np.unique(bits).tolist():
            rows = np.flatnonzero(bits == b)
            self.by_bits[b] = rows, np.stack([data[x : x + b // 8] for x in at[rows].tolist()]).view(np.uint64)


def bounds(one: Members, two: Members, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i of one and j of the other that have different labels and may be similar by ``least``, and an upper bound of
    their similarity: sets of a and b shingles that differ in p of them or more have one of (a + b - p) / (a + b + p) at most."""
    found = [[], [], []]
    for bits, (rows, data) in one.by_bits.items():
        for bits2, (rows2, data2) in two.by_bits.items():
            if max(bits, bits2) > 2 * min(bits, bits2):
                continue  # one set is less than half the other
            a, b = data, data2
            a = a if bits <= bits2 else a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
            b = b if bits2 <= bits else b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            step = max(1, (1 << 18) // b.size)
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                differ = np.bitwise_count(a[start : start + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                n, n2 = one.sizes[some].astype(np.int64)[:, None], two.sizes[rows2].astype(np.int64)[None, :]
                differ = np.maximum(differ, abs(n - n2))
                most = (n + n2 - differ) / np.maximum(n + n2 + differ, 1)
                i, j = np.nonzero((most >= least - 1e-9) & (one.labels[some][:, None] != two.labels[rows2][None, :]))
                for out, x in zip(found, (some[i], rows2[j], most[i, j]), strict=True):
                    out.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in found)


def spanning(labels: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> list[int]:
    """Of pairs (i, j) those that connect classes that heavier ones do not: fewer than there are rows."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    out = []
    for k in np.argsort(-weight, kind="stable").tolist():
        a, b = top(int(labels[i[k]])), top(int(labels[j[k]]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append(k)
    return out


_CROWD = ("bucket", "label", "rep", "size", "sketch")
_BLOCK = "bucket long, block long, low long, high long, labels binary, reps binary, sizes binary, sketches binary"


def cut_blocks(batches, most: int, most_bytes: int = 1 << 20, chained: bool = False):
    """Of rows (bucket, label, rep, size, sketch) in order: blocks of at most ``most`` rows of one bucket, or of about
    ``most_bytes`` of sketches, as tuples (bucket, first rep, lowest label, highest label, and four packed columns).
    ``chained``: the last row of a block is the first one of the next block of its bucket as well."""

    def packed(block):
        labels, reps, sizes = (np.array([r[k] for r in block], t) for k, t in ((1, np.int64), (2, np.int64), (3, np.int32)))
        return block[0][0], block[0][2], int(labels.min()), int(labels.max()), labels.tobytes(), reps.tobytes(), sizes.tobytes(), b"".join(r[4] for r in block)

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (rows[0][0] != row[0] or len(rows) == most or held >= most_bytes):
                yield packed(rows)
                rows = rows[-1:] if chained and len(rows) > 1 and rows[0][0] == row[0] else []
                held = sum(len(r[4]) for r in rows)
            rows.append(row)
            held += len(row[4])
    if rows:
        yield packed(rows)


def _grouped(items, size: int):
    held = []
    for item in items:
        held.append(item)
        if len(held) == size:
            yield held
            held = []
    yield held


def _blocks(most: int):
    def run(batches):
        for some in _grouped(cut_blocks(batches, most), 16):
            columns = [[x[k] for x in some] for k in range(8)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.binary()) for c in columns[4:])], ["bucket", "block", "low", "high", "labels", "reps", "sizes", "sketches"])

    return run


def _forest(most: int, least: float):
    """Of each block the pairs that would connect its classes, the most similar first: fewer than the block has rows."""

    def run(batches):
        for some in _grouped((b for b in cut_blocks(batches, most, chained=True) if b[2] != b[3]), 256):
            left, right = [], []
            for block in some:
                rows = Members(*block[4:])
                i, j, weight = bounds(rows, rows, least)
                for k in spanning(rows.labels, i, j, weight):
                    pair = int(rows.reps[i[k]]), int(rows.reps[j[k]])
                    left.append(max(pair))
                    right.append(min(pair))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["rep", "leader"])

    return run


def _across(least: float):
    """Of pairs of blocks: all pairs of rows of different labels that may be links.  A block paired with itself gives each
    pair of its rows."""

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = Members(*row[:4]), Members(*row[4:])
                i, j, most = bounds(one, two, least)
                i, j = i.astype(np.int64), j.astype(np.int64)
                r1, r2, l1, l2 = one.reps[i], two.reps[j], one.labels[i], two.labels[j]
                columns = [np.maximum(r1, r2), np.minimum(r1, r2), np.maximum(l1, l2), np.minimum(l1, l2)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(most, pa.float64())], ["rep", "leader", "l1", "l2", "most"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, bands: int = 25, rows: int = 5, block: int = 128) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the smallest id of its class), kept (the row has that id).

    Texts are linked if their sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more; a shorter
    text is one shingle.  Classes are what links and copies connect.  Texts with equal words, empty ones included, are
    copies: one of them stands for all.  With 25 bands of 5 registers a pair at 0.8 meets in a bucket with probability 0.9999.

    First the members of each bucket, in order of the registers of other bands, are cut into blocks of at most ``block``
    rows; of a block the most similar pairs that connect it are compared, fewer than it has rows, so this work grows with
    the input however large a bucket is.  A row that two blocks share connects them.  At first each text is in the fullest of
    its buckets alone, then in all of them, where only pairs of different classes are left to compare: a large class takes
    a few links for each member, not one for each member and bucket.  Buckets that still hold several classes go through an
    exact rest: every block meets itself and every other block of the bucket, unless both hold one and the same class, and
    every pair in different classes that the sketches do not rule out is compared, the best between two classes first, then
    all that are still apart.  So no link is lost that shares a bucket.  Blocks are dealt out in pairs, so no task gathers a
    bucket; the work in a bucket of n members that nothing links grows with n squared, at a few bytes compared for each pair.

    Rows with a null id are returned with the class of their copies, else with none.  Repeated rows repeat their result.
    Null texts count as empty; without documents there is no row.  Other columns are not read.
    """
    text = text_or_empty(text_col)
    words = words_hashed(text)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.trim(F.regexp_replace(text, GAP, " ")), 256)).alias("same"), words.alias("words"))
    signed = written(base.mapInArrow(_sign(width, bands, rows), "id long, same binary, bands array<bigint>, size int, sketch binary"), "signed")
    stand = written(signed.where(F.col("id").isNotNull()).groupBy("same").agg(F.min(F.struct("id", "bands", "size", "sketch")).alias("x")).select("same", F.col("x.id").alias("rep"), "x.bands", "x.size", "x.sketch"), "stand")
    # The places of the next two bands go with each bucket; sketches follow only where buckets are shared.
    other = lambda by: F.element_at("bands", ((F.col("band") + by) % bands + 1).cast("int"))
    members = stand.select("rep", "bands", F.posexplode("bands").alias("band", "bucket")).select("rep", "bucket", other(1).alias("k1"), other(2).alias("k2"))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = written(members.join(crowded, "bucket"), "places")
    fullest = F.max(F.struct("n", "bucket")).over(Window.partitionBy("rep"))["bucket"]
    crowd = crowd.select("bucket", "rep", "k1", "k2", (F.col("bucket") == fullest).alias("first"))
    crowd = written(crowd.join(stand.select("rep", "size", "sketch"), "rep"), "crowd")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where(F.col("id").isNotNull())
    # Repeated ids are one document; the smallest text stands for it.
    asked = written(texts.join(crowd.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "asked")
    tested, labels = no_pairs(docs), None

    def compare(pairs: DataFrame) -> bool:
        """Judge pairs that were not compared before; whether they bring links, which labels then follow."""
        nonlocal tested, labels
        fresh = written(pairs.select("rep", "leader").distinct().join(tested, ["rep", "leader"], "left_anti"), "pairs")
        if fresh.isEmpty():
            return False
        one = fresh.join(asked.select(F.col("id").alias("rep"), words_hashed(F.col("text")).alias("a")), "rep")
        two = one.join(asked.select(F.col("id").alias("leader"), F.col("text").alias("_b")), "leader").select("rep", "leader", "a", words_hashed(F.col("_b")).alias("b"))
        judged = written(two.mapInArrow(_verify(width, least), "rep long, leader long, similarity double"), "judged")
        good = judged.where(F.col("similarity") >= least).select("rep", "leader")
        tested = tested.unionByName(judged.select("rep", "leader"))
        if good.isEmpty():
            return False
        labels = connected(good, "rep", "leader", labels)
        return True

    def named(members: DataFrame) -> DataFrame:
        if labels is None:
            return members.withColumn("label", F.col("rep"))
        return members.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep"))

    order = ["bucket", "k1", "k2", "rep"]
    for some in (crowd.where("first"), crowd):
        dealt = named(some).repartitionByRange(*order).sortWithinPartitions(*order)
        compare(dealt.select(*_CROWD).mapInArrow(_forest(block, least), "rep long, leader long"))
    classed = named(crowd.select("bucket", "rep", "size", "sketch"))
    several = classed.groupBy("bucket").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("bucket")
    order = ["bucket", "label", "rep"]
    apart = written(classed.join(several, "bucket", "left_semi").select(*_CROWD), "apart")
    blocks = written(apart.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(block), _BLOCK), "blocks")
    packed = ["labels", "reps", "sizes", "sketches"]
    again = [F.col(c).alias(f"{c}2") for c in packed]
    inner = blocks.where("low <> high").select(*packed, *again)
    heads = blocks.select("bucket", "block", "low", "high")
    second = heads.toDF("bucket", "block2", "low2", "high2")
    meet = heads.join(second, "bucket").where("block < block2 and least(low, low2) <> greatest(high, high2)").select("bucket", "block", "block2")
    cross = meet.join(blocks.select("bucket", "block", *packed), ["bucket", "block"])
    cross = cross.join(blocks.select("bucket", F.col("block").alias("block2"), *again), ["bucket", "block2"])
    near = inner.unionByName(cross.select(inner.columns)).mapInArrow(_across(least), "rep long, leader long, l1 long, l2 long, most double")
    near = written(near.distinct().join(tested, ["rep", "leader"], "left_anti"), "near")
    if compare(near.groupBy("l1", "l2").agg(F.max_by(F.struct("rep", "leader"), F.struct("most", "rep", "leader")).alias("x")).select("x.rep", "x.leader")):
        new = labels.select("node", "label")
        near = near.join(new.toDF("rep", "_l1"), "rep", "left").join(new.toDF("leader", "_l2"), "leader", "left").where("coalesce(_l1, rep) <> coalesce(_l2, leader)")
    compare(near)
    rows_out = signed.select("id", "same").join(stand.select("same", "rep"), "same", "left")
    if labels is None:
        classes = rows_out.select("id", F.col("rep").alias("class_id"))
    else:
        classes = rows_out.join(labels.select("node", "label"), F.col("rep") == F.col("node"), "left").select("id", F.coalesce("label", "rep").alias("class_id"))
    return classes.select(F.col("id").alias(id_col), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def no_pairs(docs: DataFrame) -> DataFrame:
    """No pair."""
    return docs.sparkSession.createDataFrame([], "rep long, leader long")
