"""Path functions as Spark expressions; paths use / and are relative to the root."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schemas import EXTENSIONS


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def normalised(path: Column) -> Column:
    """Without empty and . steps, and with .. applied; steps above the root stay as .. ."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(F.concat(done, F.array(F.lit("x"))), -2) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def joined(base: Column, relative: Column) -> Column:
    return normalised(F.concat_ws("/", base, relative))


def language_of(path: Column) -> Column:
    """The language of a path's ending; null if there is none."""
    table = F.create_map(*[F.lit(x) for language, endings in EXTENSIONS.items() for e in endings for x in (e, language)])
    return F.try_element_at(table, F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1))


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: ** crosses directories, * and ? don't, and a last /** also stands for nothing.
    Dots match any character, as they always did."""
    out = re.sub(r"\*\*|\*|\?", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}[m.group()], glob)
    return f"^{out[:-3]}(?:/.*)?$" if out.endswith("/.*") else f"^{out}$"


def excluded(path: Column, globs: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for glob in globs:
        hit = hit | F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob_pattern(glob))
    return hit
