"""Byte-level BPE without a merge loop over the text.

Bytes become Latin-1 characters, so an Aho-Corasick automaton yields the longest vocabulary entry that starts at a byte.  From those the encoding is built left to right: take the longest entry that may follow the last
token, fall back to shorter prefixes, and step back if none fits, never entering a byte position twice that led nowhere.
Two tokens may be neighbours exactly if merging their joined bytes gives the two again; that is told from the parts at
their edges, going back through their merges, and memoised.  The one
sequence whose neighbours all fit is the one that the merges give.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Lookup, data_of, places_of, slices, text_or_empty

#: A space before something that is no white space always begins a piece, so texts may be cut there.
CHUNK = regex.compile(r"(?= [^\s\x1c-\x1f])")
GAP_PAIR = regex.compile(r" [\s\x1c-\x1f]| $")
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
UNMARKED = bytes(b for b in range(256) if b not in MARKS)
#: Marks and control characters become full stops, other white space than spaces line ends, and all else spaces, but for
#: the apostrophe, which may begin a piece.
MARKED = bytes(39 if b == 39 else 10 if 9 <= b <= 13 else 46 if b in MARKS or b < 32 or b == 127 else 32 for b in range(256))
#: What is neither ASCII nor a letter.
OTHERS = regex.compile(r"[^\x00-\x7f\p{L}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder for one rank file.  Memo tables are emptied when they reach ``memo`` entries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 400_000):
        self.ranks = ranks
        self.entries = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.memo = memo
        self.automaton = ahocorasick.Automaton()
        for entry, i in ranks.items():
            self.automaton.add_word(entry.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.odd: set[int] = set()
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks = Lookup(lambda chunks: [self._chunk(c.decode()) for c in chunks], memo)
        self.by_id = pa.array([self.entries.get(i, b"") for i in range(max(self.entries) + 1)], pa.binary())

    def merged(self, data: bytes) -> tuple[list[int], list[bytes]]:
        """The ids that the merges give, and the two parts that the last merge joined, if there was one."""
        parts, joined = [data[i : i + 1] for i in range(len(data))], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            joined = parts[at : at + 2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts], joined

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from: (-1, -1) for a single byte; None if its bytes give something else,
        or if a part has a later rank than the whole."""
        if token not in self.parts:
            own = self.entries[token]
            if len(own) == 1:
                out = -1, -1
            else:
                ids, joined = self.merged(own)
                out = tuple(self.ranks[p] for p in joined) if ids == [token] else None
                if out and (max(out) > token or None in map(self.halves, out)):
                    self.odd.add(token)
            self.parts[token] = out
        return self.parts[token]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two again.

        Going back in time from the two, the later made of the last part on the left and the first part on the right is
        taken apart.  The merges would have joined two such neighbours if that has an earlier rank than what became of
        them; of equal ranks the leftmost goes first.
        """
        until_a = until_b = 1 << 60
        while True:
            rank = self.ranks.get(self.entries[a] + self.entries[b])
            if rank is not None and rank < until_a and rank <= until_b:
                return False
            x, y = self.halves(a)[1], self.halves(b)[0]
            if y >= 0 and (b >= a or x < 0):
                b, until_b = y, b
            elif x >= 0:
                a, until_a = x, a
            else:
                return True

    def may_follow(self, left: int, right: int) -> bool:
        """left is -1 at the beginning: then whether the entry is what its own bytes merge to."""
        key = left, right
        out = self.fits.get(key)
        if out is None:
            if len(self.fits) >= self.memo:
                self.fits.clear()
            if self.halves(right) is None or left < 0:
                out = self.halves(right) is not None
            elif self.halves(left) is None or left in self.odd or right in self.odd:
                out = self.merged(self.entries[left] + self.entries[right])[0] == [left, right]
            else:
                out = self.stay_apart(left, right)
            self.fits[key] = out
        return out

    def prefix(self, token: int) -> int:
        """The longest entry that is a proper prefix of an entry; -1 if there is none."""
        out = self.shorter.get(token)
        if out is None:
            entry = self.entries[token]
            out = next((r for n in range(len(entry) - 1, 0, -1) if (r := self.ranks.get(entry[:n])) is not None), -1)
            self.shorter[token] = out
        return out

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        latin, size_of, fits, longest = data.decode("latin-1"), self.sizes, self.fits, self.automaton.iter_long
        dead = bytearray(len(data) + 1)
        out: list[int] = []
        at, last = 0, -1
        token = next(longest(latin, 0))[1]
        while at < len(data):
            while token >= 0 and (dead[at + size_of[token]] or not (ok if (ok := fits.get((last, token))) is not None else self.may_follow(last, token))):
                token = self.prefix(token)
            if token >= 0:
                out.append(token)
                at += size_of[token]
                last = token
                token = next(longest(latin, at))[1] if at < len(data) else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= size_of[token]
                last = out[-1] if out else -1
                token = self.prefix(token)
            else:
                raise ValueError("the ranks lack a single byte")
        return tuple(out)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(chunk):
            got = self.known.get(piece)
            if got is None:
                got = self.encode_piece(piece)
                if len(piece) < 64 and len(piece) < len(chunk):  # the table of chunks keeps a piece that is all of one
                    if len(self.known) >= self.memo:
                        self.known.clear()
                    self.known[piece] = got
            ids.extend(got)
        return np.array(ids, "<u4").tobytes()

    def split(self, texts: list[str]) -> pa.ListArray:
        """Parts of each text that are encoded apart."""
        if any("\0" in t for t in texts):
            return pa.array([CHUNK.split(t) for t in texts], pa.list_(pa.string()))
        return pc.split_pattern(pa.array([self.marked(t) for t in texts], pa.binary()).cast(pa.string()), "\0")

    def marked(self, text: str) -> bytes:
        """The text with a zero byte wherever it may be cut: before a space, and, if it has but ASCII and letters and no
        mark touches another or other white space before it, on both sides of a mark, which keeps the space before it."""
        if GAP_PAIR.search(text):
            return CHUNK.sub("\0", text).encode()
        data = text.encode()
        marks = data.translate(MARKED)
        cut = data.replace(b" ", b"\0 ")
        if b".." in marks or b"\n." in marks or b"'" in marks or not (text.isascii() or OTHERS.search(text) is None):
            return cut
        for mark in set(data.translate(None, UNMARKED)):
            cut = cut.replace(bytes([mark]), b"\0%c\0" % mark)
        return cut.replace(b" \0", b" ").replace(b"\0\0", b"\0")

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the places at which those of each text begin and end."""
        parts = self.split(texts)
        ids = self.chunks.take(parts.flatten())
        at = places_of(ids)[parts.offsets.to_numpy()] // 4
        return np.frombuffer(data_of(ids), "<u4")[: at[-1]], at

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The bytes of all ids, cut at the given places."""
        entries = self.by_id.take(pa.array(ids))
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(places_of(entries)[at]), entries.buffers()[2] or pa.py_buffer(b"")])

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text, as unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        entries = self.entries
        return b"".join([entries[i] for i in ids])


_CODERS: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per Python worker and vocabulary."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` array<int>, and with ``decoded`` also the bytes that the ids decode to.

    Null and empty texts have no ids and decode to no bytes; repeated rows and null ids pass through; other columns are
    not read.  ``vocabulary`` is the path of a rank file that every worker can read.
    """

    def run(batches):
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                ids, at = bpe.encode_all(part.column(1).to_pylist())
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))]
                if decoded:
                    columns.append(bpe.decode_all(ids, at))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])
                # Arrow's pool would keep what a part has freed, also while the worker waits for a task of a later job.
                del part, ids, at, columns
                pa.default_memory_pool().release_unused()

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "id long, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: id and ``decoded`` bytes; null ids arrays decode to no bytes."""

    def run(batches):
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            out = [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    return tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)
