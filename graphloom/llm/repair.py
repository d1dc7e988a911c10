"""Token ids in grammar-compressed blocks, stored as Parquet.

Documents are dealt by ranges of their id and sorted, so the files hold them in ascending order.  Each task turns its texts
into ids and cuts them into blocks of whole documents.  In a block, frequent pairs of neighbouring symbols become new
symbols, round after round, until no pair is frequent (a round replaces all pairs near the top at once); pairs never reach over the end of a document.  A block stores its
rules, how many ids each rule expands to, the symbols, and where each document begins among them, so one document, or a
range of ids in it, is decoded without the rest.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import Lookup, data_of, places_of, slices, text_or_empty, written

#: Id that ends each document.
END = 1
BLOCK_SCHEMA = "part int, block int, low long, high long, local_start long, n_ids long, doc_ids array<bigint>, doc_tokens array<bigint>, doc_symbols array<bigint>, base int, rules binary, expansions binary, wide boolean, symbols binary"
_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("local_start", pa.int64()), ("n_ids", pa.int64())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "doc_tokens", "doc_symbols")]
    + [("base", pa.int32()), ("rules", pa.binary()), ("expansions", pa.binary()), ("wide", pa.bool_()), ("symbols", pa.binary())]
)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


LETTERS = _byte_letters()
#: A word of letters and the ASCII marks behind it.
SPOKEN = re.compile(rb"([A-Za-z\x80-\xff]+)([!-/:-@\[-`{-~]*)")
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
UNMARKED = bytes(b for b in range(256) if b not in MARKS)
ASCII = bytes(range(128))
#: Marks and control characters become full stops and all else spaces, but for the apostrophe, which may begin a piece.
MARKED = bytes(39 if b == 39 else 46 if b in MARKS or b < 9 or 13 < b < 32 or b == 127 else 32 for b in range(256))


class Plain(dict):
    """Whether a character beyond ASCII is a letter that keeps to itself, as the tokenizer has it: one letter before and
    after it normalises, which no neighbour changes.  The tokenizer is asked once for each character.

    Left out, to be safe: what may compose with a neighbour (conjoining jamo; marks are no letters) and the capital sigma,
    whose lower case depends on what follows.
    """

    def __init__(self, tokenizer):
        self.normal = tokenizer.normalizer.normalize_str
        self.pieces = tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, c: str) -> bool:
        low = c.lower()
        alone = ord(c) < 0x10000 and not "\u1100" <= c <= "\u11ff" and c != "\u03a3" and unicodedata.category(c)[0] == "L"
        self[c] = alone and len(low) == 1 and unicodedata.category(low)[0] == "L" and self.normal(f"x{c}x") == f"x{low}x" and self.normal(f".{c}.") == f".{low}." and len(self.pieces(f"x{low}x")) == 1 and len(self.pieces(f".{low}.")) == 3
        return self[c]


class WordIds:
    """Ids of white-space-separated words, found by the tokenizer.

    Exact for tokenizers whose pieces never cross ASCII white space and that drop it, that normalise to composed lower
    case, part letters from punctuation, and merge the bytes of each piece, as the one used here.  A text of
    ASCII and plain letters in which no two marks touch is lowered and its marks are set apart first, so that far fewer
    different words are met; of any other text the words are taken as they stand.  Words are looked up by the batch in a
    table of known ones, which is emptied when it reaches ``most`` words, and the new ones go to the tokenizer together.
    """

    def __init__(self, path: str, most: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.size = self.tokenizer.get_vocab_size()
        self.kind, self.code = (np.dtype("<u2"), "H") if self.size <= 1 << 16 else (np.dtype("<u4"), "I")
        self.plain = Plain(self.tokenizer)
        self.known = Lookup(self.learn, most)

    def letters(self, word: bytes) -> bool:
        """Whether a word is one piece of letters."""
        if word.isascii():
            return word.isalpha()
        rest = set(word.translate(None, ASCII).decode())
        return all(map(self.plain.__getitem__, rest)) and word.decode().isalpha()

    def separated(self, text: str) -> bytes:
        """The text, with its marks set apart and lowered if that changes no id."""
        data = text.encode()
        marks = data.translate(MARKED)
        if b".." in marks or b"'" in marks:
            return data
        if not text.isascii() and not all(map(self.plain.__getitem__, set(data.translate(None, ASCII).decode()))):
            return data
        data = text.lower().encode()
        for mark in set(data.translate(None, UNMARKED)):
            data = data.replace(bytes([mark]), b" %c " % mark)
        return data

    def whole(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, which goes to the tokenizer as it stands."""
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def of_piece(self, word: bytes) -> bytes:
        """Ids of a word that is one piece: what the tokenizer merges its lowered bytes to."""
        low = word.lower().decode() if word.isascii() else "".join([LETTERS[b] for b in word.decode().lower().encode()])
        return array(self.code, [t.id for t in self.merges(low)]).tobytes()

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        pieces, others, joined = [], [], {}
        for word in words:
            if self.letters(word):
                pieces.append(word)
            elif (m := SPOKEN.fullmatch(word)) and m[2] and self.letters(m[1]):
                joined[word] = m[1].decode().lower().encode(), m[2]
            else:
                others.append(word)
        known = {w: self.of_piece(w) for w in pieces} | dict(zip(others, self.whole(others), strict=True))
        known |= {w: self.of_piece(w) for w in {stem for stem, _ in joined.values()} if w not in known}
        marks = [w for w in {marks for _, marks in joined.values()} if w not in known]
        known |= dict(zip(marks, self.whole(marks), strict=True))
        return [known[w] if w in known else known[joined[w][0]] + known[joined[w][1]] for w in words]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the places at which those of each text begin and end."""
        parts = pc.ascii_split_whitespace(pa.array([self.separated(t) for t in texts], pa.binary()).cast(pa.string()))
        ids = self.known.take(parts.flatten())
        at = places_of(ids)[parts.offsets.to_numpy()] // self.kind.itemsize
        return np.frombuffer(data_of(ids), self.kind)[: at[-1]], at

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_WORDS: dict[str, WordIds] = {}


def words_of(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def _widths(small: bool) -> tuple:
    """Of 16-bit or 32-bit symbols: their type, that of a pair, the shift of the first, and a hash to 20 bits."""
    if small:
        return np.uint16, np.uint32, 16, lambda keys: (keys * np.uint32(0x9E3779B1)) >> np.uint32(12)
    return np.uint32, np.uint64, 32, lambda keys: (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, least: int = 16, near: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), the symbols that are left, and for each whether it ends a document.

    In a round the pairs that occur at least 1/``near`` as often as the most frequent one, and at least ``least`` times,
    become rules in order of frequency; a pair waits for a later round if one of its symbols is claimed on the other side
    by a more frequent pair, so the rules of a round never overlap.  It ends when no pair occurs ``least`` times.  A pair
    that did not is counted again only if it has a new symbol; pairs are told apart by a table of hash bits, which may only
    count too many.  Symbols take 16 bits until these are used up, then 32.
    """
    small = base < 1 << 16
    kind, pair, shift, hashed = _widths(small)
    symbols, last = ids.astype(kind), ends.copy()
    rules: list[tuple[int, int]] = []
    counted, fresh = None, base
    while len(symbols) > 1:
        keys = symbols[:-1].astype(pair)
        keys <<= pair(shift)
        keys |= symbols[1:]
        place = hashed(keys)
        inside = ~last[:-1]
        wanted = inside
        if counted is not None:
            new = symbols >= fresh
            wanted = (counted[place] | new[:-1] | new[1:]) & inside
        found = np.sort(keys[wanted])
        if len(found) < least:
            break
        edge = np.concatenate(([0], np.flatnonzero(found[1:] != found[:-1]) + 1))
        counts = np.diff(edge, append=len(found))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        values, counts = found[edge[often]], counts[often]
        counted = np.zeros(1 << 20, bool)
        counted[hashed(values)] = True
        top = counts >= int(counts.max()) // near
        values, counts = values[top], counts[top]
        fresh, most = base + len(rules), (1 << 16 if small else 1 << 32) - base
        left, right, chosen = set(), set(), []
        for key in values[np.lexsort((values, -counts))].tolist():
            a, b = key >> shift, key & ((1 << shift) - 1)
            if a in right or b in left or (a == b and (a in left or b in right)):
                continue
            left.add(a)
            right.add(b)
            chosen.append(key)
            rules.append((a, b))
            if len(rules) == most:
                break
        table = np.array(chosen, pair)
        number = np.arange(fresh, fresh + len(chosen)).astype(kind)
        index = np.zeros(1 << 20, np.int32)
        index[hashed(table)] = np.arange(1, len(table) + 1)
        which = index[place]
        at = np.flatnonzero((which != 0) & inside)
        which, met = which[at] - 1, keys[at]
        # Where two rules share a hash, the table holds one of them; the other's places are looked up in order.
        wrong = np.flatnonzero(table[which] != met)
        if len(wrong):
            order = np.argsort(table)
            which[wrong] = order[np.minimum(np.searchsorted(table[order], met[wrong]), len(table) - 1)]
            hit = table[which] == met
            at, which = at[hit], which[hit]
        # In a run of one symbol the places overlap; every second one counts.
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        offset = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
        at, which = at[offset % 2 == 0], which[offset % 2 == 0]
        symbols[at] = number[which]
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
        if small and len(rules) == most:
            small, counted = False, None
            kind, pair, shift, hashed = _widths(small)
            symbols = symbols.astype(kind)
    return np.array(rules, np.uint32).reshape(-1, 2), symbols, last


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


class Block:
    """One stored block, decoded as far as asked."""

    def __init__(self, row: dict):
        self.base = row["base"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["expansions"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2").astype(np.int64)
        self.doc_symbols = np.asarray(row["doc_symbols"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.pool = np.empty(self.base + self.starts[-1], "<u4")
        self.pool[: self.base] = np.arange(self.base)
        place = lambda s: (s, s + 1) if s < self.base else (self.base + self.starts[s - self.base], self.base + self.starts[s - self.base + 1])
        for i, (a, b) in enumerate(self.rules.tolist()):
            (a0, a1), (b0, b1), at = place(a), place(b), self.base + self.starts[i]
            self.pool[at : at + a1 - a0] = self.pool[a0:a1]
            self.pool[at + a1 - a0 : at + a1 - a0 + b1 - b0] = self.pool[b0:b1]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.base
        inside = np.where(rule, symbols - self.base, 0)
        lengths = np.where(rule, self.lengths[inside], 1) if len(self.lengths) else np.ones(len(symbols), np.int64)
        starts = np.where(rule, self.base + self.starts[inside], symbols)
        before = np.cumsum(lengths) - lengths
        return self.pool[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.doc_symbols[i] : self.doc_symbols[i + 1]])

    def ids_of(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document i; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.doc_symbols[i] : self.doc_symbols[i + 1]]
        lengths = np.array([self.lengths[s - self.base] if s >= self.base else 1 for s in symbols.tolist()], np.int64)
        after = np.cumsum(lengths)
        a, b = np.searchsorted(after, start, "right"), np.searchsorted(after, stop, "left") + 1
        skipped = after[a - 1] if a else 0
        return self.expand(symbols[a:b])[start - skipped : stop - skipped]


def pack(doc_ids: list, ids: list[np.ndarray], base: int, least: int = 16) -> dict:
    """A stored block of the documents' ids, each with the id that ends it."""
    return pack_flat(doc_ids, np.concatenate(ids), np.array([len(x) for x in ids], np.int64), base, least)


def pack_flat(doc_ids: list, flat: np.ndarray, tokens: np.ndarray, base: int, least: int = 16) -> dict:
    """A stored block of ids one after another, ``tokens`` of them for each document."""
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(tokens) - 1] = True
    rules, symbols, last = compress(flat, ends, base, least)
    wide = base + len(rules) > 1 << 16
    named = [x for x in doc_ids if x is not None]
    return {
        "low": min(named, default=None), "high": max(named, default=None), "n_ids": len(flat), "doc_ids": doc_ids, "doc_tokens": tokens.tolist(), "doc_symbols": [0, *(np.flatnonzero(last) + 1).tolist()], "base": base,
        "rules": rules.astype("<u4").tobytes(), "expansions": expansion_lengths(rules, base).astype("<u4").tobytes(), "wide": wide, "symbols": symbols.astype("<u4" if wide else "<u2").tobytes(),
    }


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, block_ids: int = 1 << 21, least: int = 16) -> None:
    """Writes the ids of ``docs`` to ``path``, in blocks of about ``block_ids`` ids of whole documents, in order of id.

    Each document ends with the id ``end``; a null or empty text is that id alone.  Null ids come first; equal ids are
    ordered by text.  Other columns are not read.  A task that is lost is run again and commits its file once.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = words_of(tokenizer), TaskContext.get().partitionId()
        state = {"block": 0, "start": 0}
        names, flats, counts, size = [], [], [], 0

        def emit(names: list, flats: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
            row = {"part": part, "block": state["block"], "local_start": state["start"]} | pack_flat(names, np.concatenate(flats), np.concatenate(counts), words.size, least)
            state["block"] += 1
            state["start"] += row["n_ids"]
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for piece in (x for batch in batches for x in slices(batch)):
            ids, at = words.encode_all(piece.column(1).to_pylist())
            flat, at = np.insert(ids, at[1:], end), at + np.arange(len(at))
            docs, done = piece.column(0).to_pylist(), 0
            while done < len(docs):
                # Up to the document that fills the block.
                stop = min(int(np.searchsorted(at, at[done] + block_ids - size)), len(docs))
                names += docs[done:stop]
                flats.append(flat[at[done] : at[stop]])
                counts.append(np.diff(at[done : stop + 1]))
                size += len(flats[-1])
                done = stop
                if size >= block_ids:
                    yield emit(names, flats, counts)
                    names, flats, counts, size = [], [], [], 0
        if names:
            yield emit(names, flats, counts)

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    source.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per stored document: id, ``start`` (ids of all documents before it), n_tokens, ``ids`` (little-endian
    unsigned 32-bit integers).  Files are read by Spark, so they may lie in any store that it reads.

    Null and repeated ids keep a row each; an empty text has the closing id alone; without documents there is no row.  The
    ids of each writing task are counted from the blocks' headers; that table has a row for each task, and Catalyst
    broadcasts it only if it is small.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("part_start"))
    before = written(before, "parts")  # its size is then known

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                starts = np.cumsum([0, *row["doc_tokens"]])[:-1] + row["part_start"] + row["local_start"]
                flat = block.expand(block.symbols)
                ends = np.cumsum([0, *row["doc_tokens"]])
                data = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(data, pa.binary())], ["id", "start", "n_tokens", "ids"])

    return blocks.join(before, "part").mapInArrow(documents, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def read_document(spark: SparkSession, path: str, doc_id: int, start: int = 0, stop: int | None = None) -> list[int]:
    """Ids start to stop of one document: reads its block alone and expands no more than it needs.

    Blocks store their least and greatest id, so the files' statistics rule the others out.  Of documents that share the
    id, the first in the order of writing (by text) is read; null ids are not found; an unknown id raises ``KeyError``.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where((F.col("low") <= doc_id) & (F.col("high") >= doc_id))
    row = blocks.where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("part", "block").limit(1).first()
    if row is None:
        raise KeyError(doc_id)
    i = row["doc_ids"].index(doc_id)
    stop = row["doc_tokens"][i] if stop is None else min(stop, row["doc_tokens"][i])
    return Block(row.asDict()).ids_of(i, start, stop).tolist() if start < stop else []
