"""Textual references to definitions, as ranked joins.

Every strategy gives candidates (ref_id, id, strategy); the first strategy wins, and within it the first definition in
order.  Edges are a function of nodes and references alone, so references are kept for good and a later run may resolve
what an earlier one could not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.schemas import CALLABLE, REF_KINDS

CALL_KINDS = (*CALLABLE, "variable")
TYPE_KINDS = ("class", "interface", "enum")
MODULE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: For each language, what a module path may be called as a file, in order.
LANGUAGE_ENDINGS = {
    "typescript": MODULE_ENDINGS,
    "javascript": MODULE_ENDINGS,
    "python": (".py", "/__init__.py"),
    "go": (".go", ""),
    "java": (".java",),
    "rust": (".rs", "/mod.rs"),
    "ruby": (".rb", ""),
    "php": (".php",),
}
EDGE_OF = {"module": "imports", "ffi": "ffi", "extends": "extends", "implements": "implements"}


def first_existing(candidates: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, target_file): the candidate (key, path, ord) with the smallest ord that is a file."""
    met = candidates.join(files.select("path").distinct(), "path")
    return met.groupBy(key).agg(F.min_by("path", "ord").alias("target_file"))


def module_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, target_file) of relative specifiers: refs are (ref_id, file_path, spec); directories don't count."""
    local = refs.where(F.col("spec").rlike("^[./]"))
    at = paths.joined(paths.dirname(F.col("file_path")), F.col("spec"))
    tried = local.select("ref_id", at.alias("at")).select("ref_id", F.posexplode(F.array(*[F.concat("at", F.lit(e)) for e in MODULE_ENDINGS])).alias("ord", "path"))
    return first_existing(tried, files, "ref_id")


def ffi_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, target_file) of binaries, by their exact path."""
    at = paths.joined(paths.dirname(F.col("file_path")), F.col("spec"))
    return refs.where(F.col("spec").rlike("^[./]")).select("ref_id", at.alias("path")).join(files.select("path").distinct(), "path").select("ref_id", F.col("path").alias("target_file"))


def module_candidates(imports: DataFrame) -> DataFrame:
    """``imports`` (file_path, language, local, original, module) of modules that may be files of the tree, with ``_key`` and
    ``_paths``, the paths that the module may be at, in order.

    Relative modules start at the importing file's directory; other ones at the root, then at src/.  Bare words of
    JavaScript, TypeScript and Go are packages outside.
    """
    outside = F.col("language").isin("typescript", "javascript", "go") & ~F.col("module").rlike("^[./]")
    crate = F.col("module").startswith("crate::")
    spelled = F.when(crate, F.replace(F.substring_index("module", "crate::", -1), F.lit("::"), F.lit("/"))).otherwise(F.replace("module", F.lit("::"), F.lit("/")))
    relative = F.col("module").rlike(r"^\.") | (F.col("language") == "ruby")
    here = paths.joined(paths.dirname(F.col("file_path")), spelled)
    starts = F.when(crate, F.array(F.concat(F.lit("src/"), spelled))).when(relative, F.array(here)).otherwise(F.array(paths.normalised(spelled), F.concat(F.lit("src/"), paths.normalised(spelled)), here))
    endings = F.array(F.lit(""))
    for language, some in LANGUAGE_ENDINGS.items():
        endings = F.when(F.col("language") == language, F.array(*map(F.lit, some))).otherwise(endings)
    every = F.flatten(F.transform(starts, lambda s: F.transform(endings, lambda e: F.concat(s, e))))
    return imports.where(~outside).select("*", _identity("file_path", "language", "local", "module").alias("_key"), every.alias("_paths"))


def source_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with the file that each module is, where there is one."""
    keyed = module_candidates(imports)
    every = keyed.select("_key", F.posexplode("_paths").alias("ord", "path"))
    return keyed.drop("_paths").join(first_existing(every, files, "_key"), "_key").drop("_key")


def _identity(*columns: str) -> Column:
    """128 bits of some columns, nulls told from empty texts."""
    return F.md5(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns]))


def _ranked(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0].select("ref_id", "id", "strategy")
    for part in parts[1:]:
        whole = whole.unionByName(part.select("ref_id", "id", "strategy"))
    best = whole.groupBy("ref_id").agg(F.min(F.struct("strategy", "id")).alias("_b"))
    return best.select("ref_id", F.col("_b.id").alias("id"), F.col("_b.strategy").alias("strategy"))


def _named(defs: DataFrame, fold: bool = False) -> DataFrame:
    """(_name, _file, id): the first definition of each name in each file; no strategy takes a later one."""
    name = F.lower("name") if fold else F.col("name")
    order = F.struct(*[F.col(c) for c in ("start_line", "start_column") if c in defs.columns], F.col("id"))
    return defs.groupBy(name.alias("_name"), F.col("file_path").alias("_file")).agg(F.min_by("id", order).alias("id"))


def same_file(refs: DataFrame, defs: DataFrame, fold: bool = False) -> DataFrame:
    """(ref_id, id) of definitions in the reference's own file; with ``fold`` blind to case."""
    name = F.lower("ref_name") if fold else F.col("ref_name")
    first = _named(defs.where(F.col("kind").isin(*CALL_KINDS)), fold)
    return refs.select("ref_id", name.alias("_name"), F.col("file_path").alias("_file")).join(first, ["_name", "_file"]).select("ref_id", "id")


def imported(refs: DataFrame, defs: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref_id, id) of definitions in the file that the name is imported from, by its name there."""
    through = imports.select(F.col("file_path").alias("_at"), F.col("local").alias("_local"), "original", "target_file").distinct()
    met = refs.join(through, (F.col("file_path") == F.col("_at")) & (F.col("ref_name") == F.col("_local")))
    return met.join(_named(defs), (F.col("_file") == F.col("target_file")) & (F.col("_name") == F.col("original"))).select("ref_id", "id")


def imported_members(refs: DataFrame, defs: DataFrame, imports: DataFrame, languages: tuple[str, ...] = ("java",)) -> DataFrame:
    """(ref_id, id) of methods of any imported class, for languages that call them by bare name."""
    through = imports.where(F.col("language").isin(*languages)).select(F.col("file_path").alias("_at"), "target_file").distinct()
    met = refs.join(through, F.col("file_path") == F.col("_at")).select("ref_id", "ref_name", "target_file")
    methods = _named(defs.where(F.col("kind").isin("method", "function")))
    return met.join(methods, (F.col("_file") == F.col("target_file")) & (F.col("_name") == F.col("ref_name"))).select("ref_id", "id")


def unique(refs: DataFrame, defs: DataFrame, fold: bool = False) -> DataFrame:
    """(ref_id, id) of names with one definition in the project."""
    spell = F.lower if fold else F.col
    once = defs.groupBy(spell("name").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id")).where("_n = 1")
    return refs.select("ref_id", spell("ref_name").alias("_ref")).join(once, F.col("_ref") == F.col("_name")).select("ref_id", "id")


def calls(refs: DataFrame, defs: DataFrame, imports: DataFrame | None = None, fold_unique: bool = False) -> DataFrame:
    """(ref_id, id, strategy): 1 same file, 2 same file blind to case, 3 imported name, 4 member of an imported class,
    5 unique in the project, and with ``fold_unique`` 6 unique blind to case."""
    defs = defs.where(F.col("kind").isin(*CALL_KINDS))
    parts = [same_file(refs, defs).withColumn("strategy", F.lit(1)), same_file(refs, defs, True).withColumn("strategy", F.lit(2))]
    if imports is not None:
        parts.append(imported(refs, defs, imports).withColumn("strategy", F.lit(3)))
        if "language" in imports.columns:
            parts.append(imported_members(refs, defs, imports).withColumn("strategy", F.lit(4)))
    parts.append(unique(refs, defs).withColumn("strategy", F.lit(5)))
    if fold_unique:
        parts.append(unique(refs, defs, True).withColumn("strategy", F.lit(6)))
    return _ranked(parts)


def inheritance(refs: DataFrame, defs: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(ref_id, id, strategy): a type that is unique by name, else the one that the import points to, else none."""
    types = defs.where(F.col("kind").isin(*TYPE_KINDS))
    parts = [unique(refs, types).withColumn("strategy", F.lit(1))]
    if imports is not None:
        parts.append(imported(refs, types, imports).withColumn("strategy", F.lit(2)))
    return _ranked(parts)


def with_ids(refs: DataFrame) -> DataFrame:
    """References with ``ref_id``, 128 bits of what they are."""
    return refs.withColumn("ref_id", _identity("source_id", "ref_name", "ref_kind", "file_path", "line", "column"))


def links(refs: DataFrame, nodes: DataFrame, files: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(ref_id, file_path, source, target, kind, line, column): what each reference that can be resolved leads to."""
    keyed = with_ids(refs)
    spec = keyed.withColumn("spec", F.col("ref_name"))
    file_nodes = nodes.where("kind = 'file'").select(F.col("file_path").alias("target_file"), "id")
    to_file = lambda df: df.join(file_nodes, "target_file").select("ref_id", "id")
    parts = [
        to_file(module_files(spec.where("ref_kind = 'module'"), files)),
        to_file(ffi_files(spec.where("ref_kind = 'ffi'"), files)),
        inheritance(keyed.where("ref_kind in ('extends', 'implements')"), nodes, imports).select("ref_id", "id"),
        calls(keyed.where(~F.col("ref_kind").isin(*[k for k in REF_KINDS if k != "function"])), nodes, imports).select("ref_id", "id"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    kind = F.lit("calls")
    for ref_kind, edge_kind in EDGE_OF.items():
        kind = F.when(F.col("ref_kind") == ref_kind, edge_kind).otherwise(kind)
    return keyed.join(found, "ref_id").select("ref_id", "file_path", F.col("source_id").alias("source"), F.col("id").alias("target"), kind.alias("kind"), "line", "column").distinct()


def resolve_all(refs: DataFrame, nodes: DataFrame, files: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(source, target, kind, line, column): the edges of all references that can be resolved."""
    return links(refs, nodes, files, imports).select("source", "target", "kind", "line", "column").distinct()


def changed_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name), in lower case, of definitions that came, went or moved between two tables of nodes.

    A strategy looks at a definition's name, kind, file and order alone, so references to other names resolve as before.
    """
    seen = ["id", "kind", "name", "file_path", "start_line", "start_column"]
    a, b = old.select(seen).distinct(), new.select(seen).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select(F.lower("name").alias("name")).distinct()


def dependents(refs: DataFrame, imports: DataFrame, names: DataFrame, moved: DataFrame | None) -> DataFrame:
    """The references, with ids, that may resolve in another way once definitions of ``names`` (name, in lower case) changed and
    the files of ``moved`` (path) appeared or went; None if none did.

    They are those of a changed name; those of a name that their file imports from a changed name; and, where files moved, those
    in files one of whose imports may be such a file, and modules that may be one.
    """
    keyed = with_ids(refs)
    parts = [keyed.join(names, F.lower("ref_name") == F.col("name"), "left_semi")]
    renamed = imports.where(~F.col("original").eqNullSafe(F.col("local"))).join(names, F.lower("original") == F.col("name"), "left_semi").select(F.col("file_path").alias("_at"), F.col("local").alias("_local"))
    parts.append(keyed.join(renamed, (F.col("file_path") == F.col("_at")) & (F.col("ref_name") == F.col("_local")), "left_semi"))
    if moved is not None:
        near = module_candidates(imports).select(F.col("file_path").alias("_at"), F.explode("_paths").alias("path")).join(moved, "path", "left_semi").select("_at").distinct()
        parts.append(keyed.join(near, F.col("file_path") == F.col("_at"), "left_semi"))
        at = paths.joined(paths.dirname(F.col("file_path")), F.col("ref_name"))
        tried = keyed.where("ref_kind in ('module', 'ffi')").withColumn("_tried", F.explode(F.array(*[F.concat(at, F.lit(e)) for e in MODULE_ENDINGS])))
        parts.append(tried.join(moved, F.col("_tried") == F.col("path"), "left_semi").drop("_tried"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["ref_id"])


def wanted(nodes: DataFrame, refs: DataFrame, imports: DataFrame) -> DataFrame:
    """The nodes that resolving ``refs`` may look at: definitions that share a name, blind to case, with one of them or with
    what its file imports, and files."""
    names = refs.select(F.lower("ref_name").alias("_w")).unionByName(imports.select(F.lower("original").alias("_w"))).distinct()
    return nodes.where("kind <> 'file'").join(names, F.lower("name") == F.col("_w"), "left_semi").unionByName(nodes.where("kind = 'file'"))
