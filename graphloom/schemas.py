"""Schemas of the property graph and the values that its columns take."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*specs: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in specs])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

NODES = _fields(
    ("id", _S, False), ("kind", _S, False), ("name", _S, False), ("qualified_name", _S, True), ("file_path", _S, False),
    ("start_line", _I, False), ("end_line", _I, False), ("start_column", _I, True), ("end_column", _I, True), ("language", _S, False),
    ("signature", _S, True), ("docstring", _S, True), ("is_exported", _B, False), ("is_async", _B, False), ("is_static", _B, False), ("is_abstract", _B, False), ("updated_at", _L, False),
)
EDGES = _fields(("id", _L, True), ("source", _S, False), ("target", _S, False), ("kind", _S, False), ("line", _I, True), ("column", _I, True))
FILES = _fields(("path", _S, False), ("content_hash", _S, False), ("language", _S, False), ("last_indexed", _L, False), ("node_count", _I, False))
REFS = _fields(("id", _L, True), ("source_id", _S, False), ("ref_name", _S, False), ("ref_kind", _S, False), ("file_path", _S, False), ("line", _I, True), ("column", _I, True))
EMBEDDINGS = T.StructType([T.StructField("node_id", _S, False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False)])

# Fixed values.
NODE_KINDS = ("file", "function", "method", "class", "interface", "type_alias", "variable", "constant", "property", "enum", "enum_member", "import", "export", "comment")
EDGE_KINDS = ("contains", "calls", "imports", "extends", "implements", "ffi")
REF_KINDS = ("module", "ffi", "extends", "implements", "function")
EXTENSIONS = {
    "typescript": (".ts", ".tsx"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", ".node", ".wasm"),
    "python": (".py",),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx"),
    "csharp": (".cs",),
    "ruby": (".rb",),
    "php": (".php",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "protobuf": (".proto",),
}
EMBEDDABLE = ("function", "method", "class", "interface", "type_alias", "enum", "variable", "constant", "property", "enum_member")
CALLABLE = ("function", "method", "class")
IMPACT_KINDS = ("calls", "imports", "extends", "ffi")
USE_KINDS = ("calls", "extends", "implements", "imports")
INHERIT_KINDS = ("extends", "implements")
CONTEXT_KINDS = ("calls", "imports", "extends", "implements", "contains")
CONTEXT_SKIP = ("import", "export", "comment", "file")
BUDGETS = {"small": 5, "medium": 15, "large": 30}
EXCLUDE = ("node_modules/**", "dist/**", "build/**", ".git/**", "*.min.js", "*.bundle.js", "__pycache__/**", ".venv/**", ".tox/**", "coverage/**", "*.log")
MAX_FILE_SIZE = 1 << 20
ORDER = ("file_path", "start_line", "start_column", "id")
