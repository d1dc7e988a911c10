"""Secret scan: detectors over a text and over every layer that decoding uncovers in it.

A worklist starts with the text itself.  Each layer is scanned, then unwrapped: percent escapes, Unicode escapes and
look-alike characters give a copy of the layer with those parts replaced; every base64 token that decodes to text, or to
a gzip, zlib, bzip2 or xz stream of text, gives a layer of its own.  New layers join the worklist until none is new.  Equal
layers are scanned once, but every place that holds one is kept, and spans found in a layer are mapped back through all
of its places to code points of the document.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty

# The detectors, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
BREAK = re.compile(r"\s+")
#: Where a compressed stream may start inside a token; zlib has no mark that is long enough and is looked for at the start alone.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
URL_SAFE = str.maketrans("-_", "+/")

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,layer:string,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string()), ("base", pa.bool_())]))


def _look_alikes() -> dict[str, str]:
    """Characters beyond ASCII that compatibility folding turns into ASCII, and those that show nothing."""
    out = {}
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) == "Cf":
            out[c] = ""
        elif c.isprintable() and (plain := unicodedata.normalize("NFKC", c)).isascii() and plain.strip():
            out[c] = plain
    return out


FOLD = _look_alikes()
FOLDS = str.maketrans(FOLD)
FOLDED = re.compile("[" + "".join(map(re.escape, FOLD)) + "]")


def detect(text: str) -> Iterator[tuple[str, int, int]]:
    """The base spans of ``text``: leftmost, non-overlapping for each kind, matches that fail their test dropped."""
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class Spliced:
    """Maps a layer made by replacing parts of its parent: pieces are (start here, start there, end there, one to one)."""

    def __init__(self, pieces: list[tuple[int, int, int, bool]]):
        self.starts = [p[0] for p in pieces]
        self.pieces = pieces

    def outer(self, start: int, end: int) -> tuple[int, int]:
        here, there, _, same = self.pieces[bisect_right(self.starts, start) - 1]
        here2, there2, end2, same2 = self.pieces[bisect_right(self.starts, end - 1) - 1]
        return there + (start - here) * same, there2 + (end - here2) if same2 else end2


class Base64Token:
    """Maps characters of a decoded token to the base64 digits that carry their bytes; ``runs`` are (digit, its place)."""

    def __init__(self, runs: list[tuple[int, int]], phase: int, text: str, codec: str):
        self.runs, self.phase, self.text, self.codec = runs, phase, text, codec
        self.plain = codec == "utf-8" and text.isascii()
        self.bytes_before: list[int] | None = None

    def _bytes(self, place: int) -> int:
        """How many bytes are before a character; counted when a span asks first, since few layers hold one."""
        if self.plain:
            return place
        if self.bytes_before is None:
            self.bytes_before = [0]
            for c in self.text:
                self.bytes_before.append(self.bytes_before[-1] + len(c.encode(self.codec, "surrogateescape" if self.codec == "utf-8" else "surrogatepass")))
        return self.bytes_before[place]

    def outer(self, start: int, end: int) -> tuple[int, int]:
        a, b = self._bytes(start), self._bytes(end)
        return _place(self.runs, self.phase + a * 8 // 6), _place(self.runs, self.phase + -(-b * 8 // 6) - 1) + 1


def _place(runs: list[tuple[int, int]], digit: int) -> int:
    first, at = runs[bisect_right(runs, (digit, 1 << 62)) - 1]
    return at + digit - first


class Folded:
    """Maps a layer without look-alikes to its parent; where these stand is found when a span asks first."""

    def __init__(self, text: str):
        self.text, self.spliced = text, None

    def outer(self, start: int, end: int) -> tuple[int, int]:
        if self.spliced is None:
            self.spliced = _splice(self.text, FOLDED, lambda c: FOLD[c])[1]
        return self.spliced.outer(start, end)


class Packed:
    """Maps everything in a compressed layer to the whole token that held it."""

    def __init__(self, at: int, end: int):
        self.at, self.end = at, end

    def outer(self, start: int, end: int) -> tuple[int, int]:
        return self.at, self.end


def _unescape(part: str) -> str:
    if part[0] == "&":
        digits = part[2:-1]
        code = int(digits[1:], 16) if digits[0] in "xX" else int(digits)
    elif part.startswith("\\u{"):
        code = int(part[3:-1], 16)
    elif part.startswith("\\u"):
        units = b"".join(int(x, 16).to_bytes(2, "little") for x in part.split("\\u")[1:])
        return units.decode("utf-16-le", "replace")
    else:
        code = int(part[2:], 16)
    return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else part


def _unpercent(part: str) -> str:
    return bytes.fromhex(part.replace("%", "")).decode("utf-8", "replace")


def _splice(text: str, pattern: re.Pattern, put) -> tuple[str, Spliced] | None:
    parts, pieces, at, made = [], [], 0, 0
    for m in pattern.finditer(text):
        if m.start() > at:
            pieces.append((made, at, m.start(), True))
            parts.append(text[at : m.start()])
            made += m.start() - at
        new = put(m.group())
        if new:
            pieces.append((made, m.start(), m.end(), False))
            parts.append(new)
            made += len(new)
        at = m.end()
    if not at:
        return None
    if at < len(text):
        pieces.append((made, at, len(text), True))
        parts.append(text[at:])
    return "".join(parts), Spliced(pieces)


def _unpack(data: bytes, most: int) -> bytes | None:
    """The content of all members of a compressed stream, as far as it can be read; None if it is none, nothing if it is
    larger than ``most`` bytes."""
    out, made = [], 0
    while data:
        if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0):
            reader = zlib.decompressobj(47)
        elif data[:3] == b"BZh":
            reader = bz2.BZ2Decompressor()
        elif data[:6] == b"\xfd7zXZ\x00":
            reader = lzma.LZMADecompressor()
        else:
            break
        try:
            # In small pieces, so that what precedes an error is kept.
            for i in range(0, len(data), 256):
                part = reader.decompress(data[i : i + 256], most + 1 - made)
                made += len(part)
                out.append(part)
                if made > most:
                    return b""
                if reader.eof:
                    data = reader.unused_data + data[i + 256 :]
                    break
            else:
                break
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            break
    return b"".join(out) if made else None


def _readings(data: bytes) -> Iterator[tuple[str, str]]:
    """Texts that ``data`` may hold, and their codecs: bytes that are not UTF-8 stay as single characters."""
    if data:
        yield data.decode("utf-8", "surrogateescape"), "utf-8"
        if 0 in data or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            for codec in ("utf-16-le", "utf-16-be"):
                yield data[: len(data) // 2 * 2].decode(codec, "surrogatepass" if len(data) > 1 else "replace"), codec


def _tokens(text: str, most: int):
    """Of every run of base64 digits, and of every such run over line ends: what it decodes to from each of the four
    positions that a group of digits may start at, so that a token behind a path, a mark or a word is read as well."""
    for pattern in (BASE64, WRAPPED):
        if pattern is WRAPPED and "\n" not in text:
            break
        for m in pattern.finditer(text):
            runs, digits, at = [], 0, m.start()
            token = m.group().rstrip("=")
            parts = []
            for gap in BREAK.finditer(token):
                runs.append((digits, at))
                parts.append(token[at - m.start() : gap.start()])
                digits += len(parts[-1])
                at = m.start() + gap.end()
            runs.append((digits, at))
            parts.append(token[at - m.start() :])
            whole = "".join(parts).translate(URL_SAFE)
            for phase in range(4):
                part = whole[phase:]
                part = part[:-1] if len(part) % 4 == 1 else part
                data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
                inner = _unpack(data, most)
                if inner == b"":
                    break
                if inner is not None:
                    for plain, _ in _readings(inner):
                        yield "packed", plain, Packed(m.start(), m.end())
                    continue
                for mark in MAGIC.finditer(data):
                    for plain, _ in _readings(_unpack(data[mark.start() :], most) or b""):
                        yield "packed", plain, Packed(_place(runs, phase + mark.start() * 8 // 6), m.end())
                for plain, codec in _readings(data):
                    if _enough(plain):
                        yield "base64", plain, Base64Token(runs, phase, plain, codec)


def _enough(text: str) -> bool:
    """Whether a secret, or a token with one, may be in a text: it takes some characters that show or fold to ASCII."""
    return sum(c.isprintable() or c in FOLD for c in text[:4096]) >= 4 or len(text) > 4096


def scan(text: str | None, most_bytes: int = 1 << 26) -> tuple[list[tuple[str, int, int, str, bool]], int]:
    """All spans of ``text`` as (kind, start, end, layer path, base), ordered, and the number of layers read.

    ``most_bytes`` bounds one decompressed layer (64 MB): a larger one is a bomb and stays packed; nothing else is capped.
    """
    if not text:
        return [], 0
    spans: dict[str, dict[tuple[str, int, int], str]] = {text: {}}
    parents: dict[str, list[tuple[str, str, object]]] = {text: []}
    work, queue = [text], deque()
    while work:
        layer = work.pop()
        for span in detect(layer):
            if span not in spans[layer]:
                spans[layer][span] = ""
                queue.append((layer, span))
        children = []
        if "%" in layer:
            children.append(("url", _splice(layer, PERCENT, _unpercent)))
        if "\\" in layer or "&#" in layer:
            children.append(("unicode", _splice(layer, ESCAPE, _unescape)))
        if not layer.isascii() and not FOLD.keys().isdisjoint(set(layer)):
            children.append(("folded", (layer.translate(FOLDS), Folded(layer))))
        inner = [(name, made) for name, made in children if made]
        inner += [(name, (plain, mapping)) for name, plain, mapping in _tokens(layer, most_bytes)]
        for name, (plain, mapping) in inner:
            if plain and plain != layer:
                if plain not in spans:
                    spans[plain], parents[plain] = {}, []
                    work.append(plain)
                parents[plain].append((layer, name, mapping))
    # A span goes up to every place that holds its layer; each is taken once, so this ends even where layers hold each other.
    while queue:
        layer, span = queue.popleft()
        for parent, name, mapping in parents[layer]:
            up = (span[0], *mapping.outer(span[1], span[2]))
            if up not in spans[parent]:
                spans[parent][up] = f"/{name}{spans[layer][span]}"
                queue.append((parent, up))
    found = spans[text]
    order = {k: i for i, k in enumerate(KINDS)}
    return [(*key, found[key], not found[key]) for key in sorted(found, key=lambda k: (k[1], order[k[0]], k[2]))], len(spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 26) -> DataFrame:
    """One row per row of ``docs``: the id, ``spans`` (kind, start, end, layer, base) and ``n_layers``.

    Null and empty texts give no span and 0 layers; null ids stay; repeated rows give repeated results; other columns of
    ``docs`` are not read, so their names cannot clash.
    """

    def run(batches):
        for batch in batches:
            rows, counts = [], []
            for text in batch.column(1).to_pylist():
                spans, n = scan(text, most_bytes)
                rows.append([dict(zip(("kind", "start", "end", "layer", "base"), s, strict=True)) for s in spans])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW), pa.array(counts, pa.int32())], ["id", "spans", "n_layers"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, f"id long, spans {SPAN_TYPE}, n_layers int").withColumnRenamed("id", id_col)
