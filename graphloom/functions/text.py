"""Text functions of the search operators, all as Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Accented letters of Latin languages and what the tokenizer folds them to.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

#: English function words by class, and verbs of asking: words of a question that name no symbol.  Callers may pass their own.
FUNCTION_WORDS = {
    "articles and determiners": "a all an another any both each either every neither no some that the these this those",
    "pronouns": "anyone anything everything he her him his i it its me mine my nobody none nothing our ours she somebody someone something their them they us we you your",
    "auxiliaries": "am are be been being can cannot could did do does doing had has have having is may might must shall should was were will would",
    "prepositions": "about across after against along among around at before behind below beside between by down during except for from in inside into like near of off on onto out over past since through to toward under until up upon with within without",
    "conjunctions": "although and as because but if nor or so than though unless whereas whether while yet",
    "questions": "how what when where which who whom whose why",
    "adverbs": "again also always ever here just maybe never not now often only quite rather soon still then there too very",
    "asking": "ask describe explain find give help know look need please show tell understand want",
}
STOP_WORDS = tuple(word for words in FUNCTION_WORDS.values() for word in words.split())


def ascii_lower(x: Column) -> Column:
    """Lower case of A to Z alone."""
    return F.translate(x, UPPER, LOWER)


def contains_like(x: Column, query: str) -> Column:
    """x LIKE '%query%', blind to the case of ASCII letters; % and _ in the query stay wildcards and \\ is a plain character."""
    pattern = query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(x).like(f"%{pattern}%")


def searchable(x: Column) -> Column:
    """The tokens of a column, lower-case and without accents, each between spaces; '' for null."""
    folded = F.translate(F.lower(F.coalesce(x, F.lit(""))), ACCENTED, PLAIN)
    return F.concat(F.lit(" "), F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def query_terms(query: str) -> list[str]:
    """Terms of a full-text query; a term of several tokens is a phrase.  The last one is a prefix."""
    plain = re.sub(r"\b(?:AND|OR|NOT)\b", " ", query, flags=re.IGNORECASE)
    terms = []
    for word in plain.split():
        for bare in re.split(r"[^\w]+", word):
            tokens = [t for t in re.split(r"[\W_]+", bare.lower().translate(str.maketrans(ACCENTED, PLAIN))) if t]
            if tokens:
                terms.append(" ".join(tokens))
    return terms


def matches_terms(columns: list[Column], query: str) -> Column:
    """Every term occurs in some column, the last as a prefix; a query without a term matches nothing.

    A row's columns are lowered once for all terms and searched in place: a token stands where no letter or digit touches it,
    and its letters with any accent that the tokenizer folds.
    """
    terms = query_terms(query)
    if not terms:
        return F.lit(False)
    patterns = [_token_pattern(term, prefix=i == len(terms) - 1) for i, term in enumerate(terms)]
    texts = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in columns])
    some = lambda t, pattern: F.exists(t, lambda x: x.rlike(pattern))
    return let(texts, lambda t: reduce(Column.__and__, [some(t, p) for p in patterns]))


def _token_pattern(term: str, prefix: bool) -> str:
    """Where the tokens of a term stand next to each other in a lower-case text."""
    spellings = {c: f"[{c}{''.join(a for a, p in zip(ACCENTED, PLAIN) if p == c)}]" for c in PLAIN}
    inner = r"[^\p{L}\p{N}]+".join("".join(spellings.get(c) or re.escape(c) for c in token) for token in term.split())
    return r"(?<![\p{L}\p{N}])" + inner + ("" if prefix else r"(?![\p{L}\p{N}])")


# Identifier shapes, in the order in which they are looked for; the last is any word.  They stand between
# characters that are no ASCII word characters.
SHAPES = (
    r"[A-Z][a-zA-Z0-9]*[a-z]+[A-Z][a-zA-Z0-9]*",
    r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+",
    r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+",
    r"[a-zA-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+",
    r"[a-zA-Z][a-zA-Z0-9_]{2,}",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def symbol_tokens(x: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of a text that may name symbols, shape by shape; of spellings that differ in case the first stays.

    The first spellings are found by sorting, so the work grows as n log n with the text.
    """
    found = [F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"), F.lit(0)) for p in SHAPES]
    found[-1] = F.filter(found[-1], lambda w: ~F.lower(w).isin(*stop_words))
    placed = F.array_sort(F.transform(F.concat(*found), lambda w, i: F.struct(F.lower(w).alias("low"), i.alias("at"), w.alias("word"))))
    first = let(placed, lambda s: F.filter(s, lambda t, j: (j == 0) | (F.get(s, j - 1)["low"] != t["low"])))
    return F.transform(F.array_sort(F.transform(first, lambda t: F.struct(t["at"].alias("at"), t["word"].alias("word")))), lambda t: t["word"])


def symbol_tokens_of(text: str, stop_words: tuple[str, ...] = STOP_WORDS) -> list[str]:
    """The same for one text on the driver."""
    seen, out = set(), []
    for i, shape in enumerate(SHAPES):
        for word in re.findall(rf"\b{shape}\b", text, flags=re.ASCII):
            low = word.lower()
            if low not in seen and not (i == len(SHAPES) - 1 and low in stop_words):
                seen.add(low)
                out.append(word)
    return out


def clean_line_comment(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"^\s*(?:///?|#)\s?", ""))


def clean_block_comment(x: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(x, r"^\s*/\*+\s?", ""), r"\s*\*+/\s*$", "")
    return F.trim(F.array_join(F.transform(F.split(bare, "\n"), lambda line: F.regexp_replace(line, r"^\s*\*\s?", "")), "\n"))


def preview(x: Column, most: int = 80) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of the character at a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text, both counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")
