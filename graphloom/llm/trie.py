"""Prefix trie of conversations by an external mergesort that knows common prefixes.

A turn is its digest, so a conversation is a string of digests.  Tasks sort their conversations into runs; each row carries
how many turns it shares with the row before it.  Runs are written, dealt out by range, and merged by a loser tree that
starts every comparison behind the turns known to be shared.  The merged stream holds the path to its last row open on a
stack; a node is finished when the next row leaves it.  Only nodes on a range's first and last path may go on in another
range: their parts, a few for each range, are summed afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty, written

#: Bytes of a turn's digest.
TURN = 16
ROOT = bytes(TURN)
Row = tuple[bytes, list[int], int | None]


def turn_sequences(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id and ``turns``, an array of (digest, bytes of the text) in order.

    Turns are ordered by ``order_col``, null first, and then by digest, so ties and repeated rows have one order.  Null roles
    and texts are empty.  Rows with a null id are one conversation.  Texts are reduced to 24 bytes before any shuffle;
    a conversation's digests must fit in a task.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    # The length keeps role and text apart.
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, TURN)
    turn = F.struct(F.col(order_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = turns.select(F.col(id_col).alias("_id"), turn.alias("_turn"))
    out = rows.groupBy("_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return out.select(F.col("_id").alias(id_col), F.transform("_turns", lambda t: F.struct(t["digest"], t["bytes"])).alias("turns"))


def with_shared_openings(sequences: DataFrame, id_col: str = "conv_id", every: int = 5, most: int = 9) -> DataFrame:
    """Conversations c rebuilt from the first h turns of conversation c - c % every and their own turns after the first h, where
    h is the checksum of c modulo ``most``.  A missing conversation gives no turn; one without id stays as it is."""
    c = F.col(id_col)
    own = sequences.select(c, "turns", (F.crc32(c.cast("string")) % most).cast("int").alias("_h"), (c - c % every).alias("_base"))
    openings = sequences.where(c % every == 0).select(c.alias("_base"), F.slice("turns", 1, most - 1).alias("_opening"))
    joined = own.join(openings, "_base", "left")
    first = F.coalesce(F.slice("_opening", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return joined.select(c, F.when(c.isNull(), F.col("turns")).otherwise(F.concat(first, rest)).alias("turns"))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns two strings begin with in common, of which ``known`` need no look."""
    low, high = known, min(len(a), len(b)) // TURN
    step = 1
    while low < high:
        middle = min(low + step, high)
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low, step = middle, 2 * step
        elif middle == low + 1:
            return low
        else:
            high, step = middle - 1, max(1, (middle - low) // 2)
    return low


def _order(row: Row) -> tuple:
    return row[0], row[2] is None, row[2] or 0


def sorted_run(rows: list[Row]) -> Iterator[tuple[int, Row]]:
    """The rows in order of strings and ids, each with the turns that it shares with the one before."""
    rows.sort(key=_order)
    before = b""
    for row in rows:
        yield shared_turns(before, row[0]), row
        before = row[0]


class LoserTree:
    """Merges sorted runs of (shared, row): each match begins behind the turns that both rivals share with the last winner.

    Every waiting row knows how many turns it shares with the last row that beat it, so a rival that shares more with the
    last winner comes first without a look at its string.  ``compared`` counts the turns that were looked at.
    """

    def __init__(self, runs: list[Iterator[tuple[int, Row]]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.compared = 0

    def _match(self, a: tuple | None, b: tuple | None) -> tuple[tuple | None, tuple | None]:
        """Winner and loser of two entries (shared, row, run); the loser knows what it shares with the winner."""
        if a is None or b is None:
            return (a, b) if b is None else (b, a)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        x, y = a[1][0], b[1][0]
        n = shared_turns(x, y, a[0])
        self.compared += n - a[0] + 1
        at = n * TURN
        p, q = x[at : at + TURN], y[at : at + TURN]
        first = p < q if p != q else (_order(a[1])[1:], a[2]) <= (_order(b[1])[1:], b[2])
        return (a, (n, *b[1:])) if first else (b, (n, *a[1:]))

    def _next(self, run: int) -> tuple | None:
        entry = next(self.runs[run], None) if run < len(self.runs) else None
        return None if entry is None else (*entry, run)

    def __iter__(self) -> Iterator[tuple[int, Row]]:
        # A tournament over leaves size..2*size-1; an inner place keeps the loser of its match.
        losers: list[tuple | None] = [None] * self.size
        level: list[tuple | None] = [None if (e := self._next(i)) is None else (0, *e[1:]) for i in range(self.size)]
        at = self.size
        while at > 1:
            at //= 2
            matches = [self._match(level[2 * i], level[2 * i + 1]) for i in range(at)]
            losers[at : 2 * at] = [m[1] for m in matches]
            level = [m[0] for m in matches]
        winner = level[0]
        while winner is not None:
            shared, row, run = winner
            yield shared, row
            # The run's next row shares with this one what the run says, and the waiting rows on its way up, which lost to
            # this row, know what they share with it.
            winner, at = self._next(run), (self.size + run) // 2
            while at:
                winner, losers[at] = self._match(winner, losers[at])
                at //= 2


class _Node:
    """An open node: what its finished subtrees and its members add up to so far."""

    __slots__ = ("path", "depth", "bytes", "members", "least", "children", "leaves", "saved", "ends", "hash", "first", "waiting")

    def __init__(self, path: bytes, depth: int, size: int, first: bool):
        self.path, self.depth, self.bytes, self.first = path, depth, size, first
        self.members = self.children = self.leaves = self.saved = self.ends = 0
        self.least: int | None = None
        self.hash = None
        self.waiting: list[tuple] = []


FIELDS = [
    ("part", pa.int64()), ("edge", pa.string()), ("path", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string()), ("bytes", pa.int64()), ("piece", pa.int64()), ("ids", pa.string()),
]
SCHEMA = "part long, edge string, path binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, ends_sha256 string, bytes long, piece long, ids string"


class OpenPath:
    """The stack of open nodes; ``add`` takes merged rows in order and yields what they finish.

    Yielded rows have FIELDS.  ``edge`` is null for a finished node whose parent's smallest member is known, 'child' for a
    finished child of a node that may go on in other ranges, 'spine' for a range's part of such a node, 'first' and 'last' for
    the places of the first and last path, and 'ids' for a piece of the ids that end at a path's tip.
    """

    def __init__(self, part: int, piece: int = 1 << 13):
        self.part, self.piece = part, piece
        self.stack: list[_Node] = []
        self.open = 0  # how many nodes of the stack are on the first path
        self.ids: list[str] = []
        self.pieces = 0
        self.tip: list[tuple] = []

    def _row(self, edge: str | None, node: _Node, parent: bytes | None, **more: object) -> tuple:
        values = {"part": self.part, "edge": edge, "path": node.path, "parent": parent, "conv_id": node.least, "depth": node.depth, "n_convs": node.members, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "n_ends": node.ends, "ends_sha256": (node.hash or hashlib.sha256()).hexdigest(), "bytes": node.bytes}
        values.update(more)
        return tuple(values.get(name) for name, _ in FIELDS)

    def _flush(self) -> Iterator[tuple]:
        if self.ids:
            yield self._row("ids", self.stack[-1], None, piece=self.pieces, ids=",".join(self.ids))
            self.ids, self.pieces = [], self.pieces + 1

    def _finish(self, last: bool) -> Iterator[tuple]:
        """Take the top node off the stack and add it to its parent."""
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        node.leaves += not node.children
        node.saved += (node.members - 1) * node.bytes
        if parent:
            parent.members += node.members
            parent.least = node.least if parent.least is None else parent.least if node.least is None else min(parent.least, node.least)
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
        spine = node.first or last
        at = [name for name, _ in FIELDS].index("parent_conv_id")
        for row in node.waiting:
            yield row if spine else (row[0], None, *row[2:at], node.least, *row[at + 1 :])
        if spine:
            for edge in ["spine"] + ["first"] * node.first + ["last"] * last:
                yield self._row(edge, node, parent.path if parent else None)
        elif parent.first:
            yield self._row("child", node, parent.path)
        else:
            parent.waiting.append(self._row("child", node, parent.path))

    def add(self, shared: int, row: Row) -> Iterator[tuple]:
        key, sizes, conv = row
        begins = not self.stack
        if begins:
            self.stack.append(_Node(ROOT, 0, 0, True))
            shared = 0
        depth = len(key) // TURN
        if not begins and not (shared == depth == len(self.stack) - 1):
            if self.stack[-1].first or self.pieces:
                yield from self._flush()
            self.ids = []
        while len(self.stack) - 1 > shared:
            yield from self._finish(False)
        for d in range(len(self.stack) - 1, depth):
            path = hashlib.sha256(self.stack[-1].path + key[d * TURN : (d + 1) * TURN]).digest()[:TURN]
            self.stack.append(_Node(path, d + 1, sizes[d], begins))
        tip = self.stack[-1]
        if tip.hash is None:
            tip.hash, self.pieces = hashlib.sha256(), 0
        tip.members += 1
        tip.least = conv if tip.least is None else tip.least if conv is None else min(tip.least, conv)
        if conv is not None:
            tip.hash.update(b"," * (tip.ends > 0) + str(conv).encode())
            tip.ends += 1
            self.ids.append(str(conv))
        if len(self.ids) >= self.piece:
            # A tip off the first path may still be the last one: its pieces go out too, and are dropped if it isn't.
            yield from self._flush()

    def end(self) -> Iterator[tuple]:
        if self.stack:
            yield from self._flush()
        while self.stack:
            yield from self._finish(True)


def _batches(rows: Iterator[tuple], fields: list, size: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*kept)) if kept else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields)], [n for n, _ in fields])

    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield batch()
            kept = []
    if kept:
        yield batch()


def _make_runs(most_rows: int) -> Callable:
    fields = [("run", pa.int64()), ("place", pa.int64()), ("shared", pa.int64()), ("key", pa.binary()), ("sizes", pa.list_(pa.int64())), ("conv_id", pa.int64())]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            held: list[Row] = []
            n = 0
            for batch in batches:
                for key, sizes, conv in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append((key or b"", sizes or [], conv))
                    if len(held) >= most_rows:
                        yield from ((task + n, i, s, *r) for i, (s, r) in enumerate(sorted_run(held)))
                        held, n = [], n + 1
            yield from ((task + n, i, s, *r) for i, (s, r) in enumerate(sorted_run(held)))

        yield from _batches(rows(), fields)

    return make


def _merge_runs(piece: int) -> Callable:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple]] = {}
        for batch in batches:
            for run, place, shared, key, sizes, conv in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(run, []).append((place, shared, (key, sizes, conv)))

        def rows() -> Iterator[tuple]:
            # A range holds a stretch of each run, which a shuffle may deliver out of order.
            parts = [sorted(runs[r], key=lambda x: x[0]) for r in sorted(runs)]
            path = OpenPath(TaskContext.get().partitionId(), piece)
            for shared, row in LoserTree([iter([x[1:] for x in p]) for p in parts]):
                yield from path.add(shared, row)
            yield from path.end()

        yield from _batches(rows(), FIELDS)

    return merge


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each path's ids, whose pieces come one after the other; a piece is held at a time."""
    fields = [("path", pa.binary()), ("_sha", pa.string())]

    def rows() -> Iterator[tuple]:
        now, digest = None, None
        for batch in batches:
            for path, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if path != now:
                    if now is not None:
                        yield now, digest.hexdigest()
                    now, digest = path, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if now is not None:
            yield now, digest.hexdigest()

    yield from _batches(rows(), fields)


def prefix_trie(sequences: DataFrame, id_col: str = "conv_id", turns_col: str = "turns", run_rows: int = 1 << 17, range_bytes: int = 32 << 20, piece: int = 1 << 13) -> DataFrame:
    """One row per node, a distinct sequence of a conversation's first turns, from the root at depth 0 on.

    ``sequences`` has a row per conversation: an integer id and an array of (digest, bytes), as ``turn_sequences`` makes it.
    Columns: conv_id, the smallest member, a conversation that begins so; depth; parent_conv_id, the parent's; n_convs,
    members; n_children; n_leaves, childless nodes of the subtree; saved_tokens, over the subtree's nodes the sum of
    (n_convs - 1) times the bytes of their last text; n_ends and ends_sha256, number and digest of the ids, in ascending
    order and joined by commas, of the members that end there.

    Null and empty arrays are conversations that end at the root.  A null id is larger than any other, is counted as a
    member, and has no place in the list of ids.  Rows that repeat an id are members each for itself.  An empty table gives
    no row.  Other columns are not read.

    Ranges are cut by string and id, so any number of equal conversations is spread over tasks; there are as many as hold
    ``range_bytes`` each.  What tasks exchange after the merge is a few rows for each range and level.  The digest of one
    node's ids is sequential by its definition: a node that spans ranges has its pieces streamed through one task, a piece
    at a time.
    """
    spark = sequences.sparkSession
    rows = sequences.select(
        F.unhex(F.array_join(F.transform(turns_col, lambda t: F.hex(t["digest"])), "")).alias("key"),
        F.transform(turns_col, lambda t: t["bytes"].cast("long")).alias("sizes"),
        F.col(id_col).cast("long").alias("conv_id"),
    )
    runs = written(rows.mapInArrow(_make_runs(run_rows), "run long, place long, shared long, key binary, sizes array<bigint>, conv_id long"), "runs")
    total = runs.agg(F.sum(F.octet_length("key") + 8 * F.size("sizes") + 40)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    dealt = runs.repartitionByRange(ranges, "key", F.col("conv_id").asc_nulls_last())
    nodes = written(dealt.mapInArrow(_merge_runs(piece), SCHEMA), "nodes")

    spine = nodes.where("edge = 'spine'")
    # Ranges without a row leave no part: neighbours are ranges with rows.  One row a range meets here.
    order = nodes.where("edge = 'last' and depth = 0").select("part", F.lead("part").over(Window.orderBy("part")).alias("_next"))
    last = nodes.where("edge = 'last'").join(order, "part").select("_next", "part", "path", "parent", "depth", "bytes")
    tips = last.groupBy("part").agg(F.max("depth").alias("_tip"))
    first = nodes.where("edge = 'first'").select(F.col("part").alias("_next"), "path")
    both = last.join(first, ["_next", "path"]).join(tips, "part")
    deeper = Window.partitionBy("part").orderBy(F.col("depth").desc())
    # What neighbours count twice: shared nodes as children, a last path that goes on as a leaf, one text of each shared node.
    twice = both.withColumn("_deepest", F.first("depth").over(deeper)).select(
        "path",
        F.when(F.col("depth") < F.col("_deepest"), -1).otherwise(0).alias("n_children"),
        F.when(F.col("_deepest") == F.col("_tip"), -1).otherwise(0).alias("n_leaves"),
        F.sum("bytes").over(deeper).alias("saved_tokens"),
    )
    counted = ["n_children", "n_leaves", "saved_tokens"]
    sums = spine.select("path", "parent", "depth", "conv_id", "n_convs", "n_ends", "ends_sha256", *counted, F.lit(1).alias("_parts")).unionByName(twice, allowMissingColumns=True)
    sums = sums.groupBy("path").agg(
        *[F.sum(c).alias(c) for c in ["n_convs", "n_ends", *counted]], *[F.max(c).alias(c) for c in ("parent", "depth")], F.min("conv_id").alias("conv_id"),
        F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).alias("_with_ends"), F.max(F.when(F.col("n_ends") > 0, F.col("ends_sha256"))).alias("_sha_one"),
    )
    sums = written(sums, "spine")
    split = sums.where("_with_ends > 1").select("path")
    pieces = nodes.where("edge = 'ids'").select("path", "part", "piece", "ids").join(split, "path", "left_semi")
    hashes = pieces.repartition("path").sortWithinPartitions("path", "part", "piece").select("path", "ids").mapInArrow(_joined_ids, "path binary, _sha string")
    above = sums.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    sums = sums.join(hashes, "path", "left").withColumn("ends_sha256", F.coalesce("_sha", "_sha_one", F.sha2(F.lit(""), 256)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "ends_sha256"]
    inner = nodes.where("edge is null").select(columns)
    own = ["parent", *[c for c in columns if c != "parent_conv_id"]]
    hung = sums.select(own).unionByName(nodes.where("edge = 'child'").select(own)).join(above, "parent", "left").select(columns)
    return inner.unionByName(hung).withColumnRenamed("conv_id", id_col)
