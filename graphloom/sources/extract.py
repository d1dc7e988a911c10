"""Source text to nodes, edges, references and imports, one file at a time.

Python is read with its own parser.  Protobuf, and the languages that bracket blocks with braces, are read by a scanner:
comments and strings are blanked, definitions are found by the patterns of a language's table, their ends by matching
braces, and what belongs to what by containment.  Ruby's blocks end where the indentation does.  The scanner knows no
types and expands no macros; what it covers for each language is the table.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

NODE_FIELDS = ("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "start_column", "end_column", "language", "signature", "docstring", "is_exported", "is_async", "is_static", "is_abstract")
BINARY = (".node", ".wasm")


def node_id(kind: str, path: str, name: str, line: int) -> str:
    return f"{kind}:{path}:{re.sub(r'[^A-Za-z0-9_$]', '_', name)}:{line}"


@dataclass
class Extraction:
    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    error: str | None = None
    known: set[str] = field(default_factory=set)
    types: dict[str, str] = field(default_factory=dict)  # the first of each name

    @property
    def file_id(self) -> str:
        return f"file:{self.path}"

    def add(self, kind: str, name: str, line: int, end: int, id_name: str | None = None, **more) -> str:
        """A node and its edge from the file; the first definition of an id wins."""
        i = node_id(kind, self.path, id_name or name, line)
        if i in self.known:
            return i
        self.known.add(i)
        row = dict.fromkeys(NODE_FIELDS) | {"id": i, "kind": kind, "name": name, "file_path": self.path, "start_line": line, "end_line": end, "start_column": 0, "end_column": 0, "language": self.language}
        row |= dict.fromkeys(("is_exported", "is_async", "is_static", "is_abstract"), False) | more
        self.nodes.append(row)
        if kind in ("class", "interface", "enum"):
            self.types.setdefault(name, i)
        self.edges.append({"source": self.file_id, "target": i, "kind": "contains", "line": None, "column": None})
        return i

    def ref(self, source: str, name: str, kind: str, line: int, column: int = 0) -> None:
        self.refs.append({"source_id": source, "ref_name": name, "ref_kind": kind, "file_path": self.path, "line": line, "column": column})

    def imported(self, local: str, original: str, module: str) -> None:
        self.imports.append({"file_path": self.path, "language": self.language, "local": local, "original": original, "module": module})

    def module(self, name: str, spec: str, line: int, end: int) -> None:
        self.add("import", name, line, end)
        self.ref(self.file_id, spec, "ffi" if spec.endswith(BINARY) else "module", line)

    def inherit(self, source: str, base: str, kind: str, line: int) -> None:
        """An edge if the file itself defines the base, else a reference."""
        own = self.types.get(base)
        if own:
            self.edges.append({"source": source, "target": own, "kind": kind, "line": line, "column": 0})
        else:
            self.ref(source, base, kind, line)


def extract(path: str, text: str | None, language: str | None) -> Extraction:
    """All of one file; any failure becomes its error, beside the file node."""
    out = Extraction(path, language or "")
    lines = (text or "").count("\n") + 1
    if language is None:
        out.error = "unsupported language"
        return out
    out.nodes.append(dict.fromkeys(NODE_FIELDS) | {"id": out.file_id, "kind": "file", "name": path.rsplit("/", 1)[-1], "qualified_name": path, "file_path": path, "start_line": 1, "end_line": lines, "start_column": 0, "end_column": 0, "language": language} | dict.fromkeys(("is_exported", "is_async", "is_static", "is_abstract"), False))
    if path.endswith(BINARY) or text is None:
        return out
    try:
        {"python": _python, "protobuf": _protobuf}.get(language, _scan)(out, text)
    except Exception as e:  # one bad file must not end the run; the error is a row
        out.error = f"{type(e).__name__}: {e}"
    return out


# --- Python ---------------------------------------------------------------------------------------------------------


def _readable_python(text: str) -> tuple[ast.Module, str | None]:
    """The tree of what can be read, and the first error.

    A line that can't be read counts as ``pass``; if that does not mend its top-level block, the block is blanked.
    """
    lines, tried, error = text.split("\n"), set(), None
    while True:
        try:
            return ast.parse("\n".join(lines)), error
        except SyntaxError as e:
            error = error or f"SyntaxError: {e}"
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
        while at > 0 and not lines[at].strip():
            at -= 1
        first = at
        while first > 0 and (not lines[first].strip() or lines[first][0] in " \t)]}"):
            first -= 1
        if first not in tried and at != first:
            tried.add(first)
            lines[at] = re.match(r"\s*", lines[at]).group() + "pass"
            continue
        last = first + 1
        while last < len(lines) and (not lines[last].strip() or lines[last][0] in " \t)]}"):
            last += 1
        if not any(lines[first:last]):
            first, last = 0, len(lines)
        lines[first:last] = [""] * (last - first)


def _python(out: Extraction, text: str) -> None:
    tree, out.error = _readable_python(text)
    lines = text.split("\n")

    def above(line: int) -> str | None:
        found = []
        while line > 1 and lines[line - 2].strip().startswith("#"):
            line -= 1
            found.insert(0, lines[line - 1].strip().lstrip("#").strip())
        return "\n".join(found) or None

    def visit(node: ast.AST, owner: str, classes: tuple[str, ...], inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            line, end = getattr(child, "lineno", 1), getattr(child, "end_lineno", 1)
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([d.lineno for d in child.decorator_list], default=line)
                marks = [ast.unparse(d) for d in child.decorator_list]
                signature = f"({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                kind = "method" if classes and not inside else "function"
                name = f"{'.'.join(classes)}.{child.name}" if kind == "method" else child.name
                i = out.add(kind, child.name, line, end, qualified_name=name, signature=signature, docstring=ast.get_docstring(child) or above(first), is_exported=not child.name.startswith("_"), is_async=isinstance(child, ast.AsyncFunctionDef), is_static="staticmethod" in marks, is_abstract=any(m.endswith("abstractmethod") for m in marks), start_column=child.col_offset)
                visit(child, i, classes, True)
            elif isinstance(child, ast.ClassDef):
                i = out.add("class", child.name, line, end, qualified_name=child.name, docstring=ast.get_docstring(child) or above(line), is_exported=not child.name.startswith("_"))
                for base in child.bases:
                    out.inherit(i, ast.unparse(base).rsplit(".", 1)[-1].split("[")[0], "extends", line)
                visit(child, i, (*classes, child.name), False)
            elif isinstance(child, ast.Lambda):
                visit(child, out.add("function", f"anonymous_at_line_{line}", line, end), classes, True)
            elif isinstance(child, ast.Import | ast.ImportFrom):
                names = child.names
                module = "." * getattr(child, "level", 0) + (getattr(child, "module", None) or "")
                if isinstance(child, ast.ImportFrom):
                    at = re.match(r"\.*", module).group()
                    target = ("./" + "../" * (len(at) - 1) if at else "") + module[len(at) :].replace(".", "/")
                    for a in names:
                        if a.name != "*":
                            out.imported(a.asname or a.name, a.name, target)
                    out.module(names[0].asname or names[0].name, target, line, end)
                else:
                    for a in names:
                        target = a.name.replace(".", "/")
                        out.imported(a.asname or a.name.rsplit(".", 1)[-1], a.name.rsplit(".", 1)[-1], target)
                    out.module(names[0].asname or names[0].name.rsplit(".", 1)[-1], names[0].name.replace(".", "/"), line, end)
            else:
                if isinstance(child, ast.Assign | ast.AnnAssign) and not inside:
                    for target in child.targets if isinstance(child, ast.Assign) else [child.target]:
                        if isinstance(target, ast.Name) and node_id("function", out.path, target.id, line) not in out.known:
                            out.add("constant" if target.id.isupper() else "property" if classes else "variable", target.id, line, end, is_exported=not target.id.startswith("_"))
                if isinstance(child, ast.Call):
                    called = child.func
                    name = called.id if isinstance(called, ast.Name) else called.attr if isinstance(called, ast.Attribute) else None
                    if name:
                        out.ref(owner, name, "function", line, child.col_offset)
                visit(child, owner, classes, inside)

    visit(tree, out.file_id, (), False)
    for number, line in enumerate(lines, 1):
        if line.strip().startswith("#"):
            _comment(out, line.strip(), number, number)


def _comment(out: Extraction, text: str, line: int, end: int) -> None:
    out.add("comment", text if len(text) <= 80 else text[:80] + "...", line, end, id_name=f"line_{line}", docstring=text)


# --- Protobuf -------------------------------------------------------------------------------------------------------


def _protobuf(out: Extraction, text: str) -> None:
    plain, comments = blank(text, "//", ("/*", "*/"), "\"'")
    at = Places(text)
    spans = Braces(plain)
    for m in re.finditer(r"\b(message|service|enum)\s+(\w+)\s*\{", plain):
        out.add("enum" if m[1] == "enum" else "class", m[2], at.line(m.start(2)), at.line(spans.end(m.end() - 1)), docstring=doc_above(comments, text, m.start()), is_exported=True)
    services = [(m[1], m.end() - 1, spans.end(m.end() - 1)) for m in re.finditer(r"\bservice\s+(\w+)\s*\{", plain)]
    for m in re.finditer(r"\brpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)", plain):
        owner = next((n for n, a, b in services if a < m.start() < b), None)
        i = out.add("method", m[1], at.line(m.start(1)), at.line(m.end()), qualified_name=f"{owner}.{m[1]}" if owner else m[1], signature=f"({m[2]}) -> {m[3]}", is_exported=True)
        for name in (m[2], m[3]):
            out.ref(i, name.rsplit(".", 1)[-1], "function", at.line(m.start()))
    for m in re.finditer(r'\bimport\s+(?:public\s+|weak\s+)?"([^"]+)"', text):
        out.module(m[1].rsplit("/", 1)[-1], m[1], at.line(m.start()), at.line(m.end()))


# --- languages with braces ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grammar:
    """Patterns of a language over blanked text.  Each definition pattern names ``name``, and may name ``params`` (where
    the parameter list opens), ``ret`` and ``bases``."""

    defs: tuple[tuple[str, str], ...]
    keywords: str = ""
    line: str = "//"
    quotes: str = "\"'`"
    arrow: str | None = None
    exported: str = ""
    ruby: bool = False


_ID = r"[A-Za-z_$][\w$]*"
_GEN = r"(?:<[^<>{}()]*(?:<[^<>]*>[^<>{}()]*)*>)?"
_MODS = r"(?P<mods>(?:\b(?:export|default|public|private|protected|internal|static|async|abstract|final|override|virtual|sealed|readonly|partial|synchronized|open|data|pub(?:\([^)]*\))?|const|unsafe|extern|inline|suspend|mutating|fileprivate|declare|native|default)\s+)*)"
#: The rest of a parameter list, brackets in balance to a depth of three.
_ARGS = r"(?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_TS_DEFS = (
    ("function", rf"{_MODS}\bfunction\b\s*\*?\s*(?P<name>{_ID})\s*{_GEN}\s*(?P<params>\()"),
    ("arrow", rf"{_MODS}\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?=(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_ID})\s*(?::[^=\n]+?)?=>)"),
    ("class", rf"{_MODS}\bclass\s+(?P<name>{_ID})\s*{_GEN}(?P<bases>[^{{;]*)\{{"),
    ("interface", rf"{_MODS}\binterface\s+(?P<name>{_ID})\s*{_GEN}(?P<bases>[^{{;]*)\{{"),
    ("type_alias", rf"{_MODS}\btype\s+(?P<name>{_ID})\s*{_GEN}\s*="),
    ("enum", rf"{_MODS}\benum\s+(?P<name>{_ID})\s*\{{"),
    ("method", rf"(?m)(?:^|(?<=[{{}};]))[ \t]*{_MODS}(?:get\s+|set\s+)?\*?(?P<name>#?{_ID})\s*{_GEN}\s*(?P<params>\()(?={_ARGS}\s*(?::[^;={{}}]+)?(?:\{{|(?<=[^)\s])\s*;))"),
    ("field", rf"(?m)(?:^|(?<=[{{}};]))[ \t]*{_MODS}(?P<name>#?{_ID})[?!]?\s*(?::[^;=(){{}}\n]+)?(?=\s*(?:=[^=>]|;))"),
    ("variable", rf"{_MODS}\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=;\n]+)?="),
)
_C_FUNC = rf"(?m)^[ \t]*{_MODS}(?!return\b|else\b|new\b|throw\b|case\b|typedef\b)(?:[\w:<>,*&\[\]?.]+[ \t*&]+)+(?:(?P<owner>{_ID})::)?(?P<name>~?{_ID})\s*(?P<params>\()(?={_ARGS}[^;{{}}()]*[{{;])"
_C_FIELD = rf"(?m)(?:^|(?<=[{{}};]))[ \t]*{_MODS}(?!return\b|else\b|typedef\b|using\b|goto\b|public\b|private\b|protected\b)(?:[\w:<>,]+[ \t*&]+)+(?P<name>{_ID})\s*(?:\[[^\]]*\]\s*)*(?:=[^;{{}}]*)?(?=;)"
_C_TYPEDEF = rf"\btypedef\s+(?:struct|union)\s*(?:{_ID}\s*)?\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}\s*(?P<name>{_ID})(?=\s*;)"
GRAMMARS = {
    "typescript": Grammar(_TS_DEFS, arrow="=>", exported="export"),
    "javascript": Grammar(_TS_DEFS, arrow="=>", exported="export"),
    "go": Grammar(
        (
            ("function", rf"(?m)^func\s+(?P<name>{_ID})\s*(?:\[[^\]]*\])?\s*(?P<params>\()"),
            ("method", rf"(?m)^func\s*\(\s*\w*\s*\*?(?P<owner>{_ID})[^)]*\)\s*(?P<name>{_ID})\s*(?P<params>\()"),
            ("class", rf"\btype\s+(?P<name>{_ID})\s+struct\s*\{{"),
            ("interface", rf"\btype\s+(?P<name>{_ID})\s+interface\s*\{{"),
            ("constant", rf"(?m)^const\s+(?P<name>{_ID})\b"),
            ("constant", rf"(?m)(?:^const\s*\(|(?<=\n))[ \t]*(?P<name>{_ID})\b(?=[^\n():{{}}]*(?:=[^=]|$))"),
            ("variable", rf"(?m)^var\s+(?P<name>{_ID})\b"),
        ),
        quotes='"`',
        arrow="func(",
    ),
    "rust": Grammar(
        (
            ("function", rf"{_MODS}\bfn\s+(?P<name>{_ID})\s*{_GEN}\s*(?P<params>\()"),
            ("class", rf"{_MODS}\bstruct\s+(?P<name>{_ID})"),
            ("impl", rf"\bimpl\s*{_GEN}\s*(?:(?P<trait>{_ID})\s*{_GEN}\s+for\s+)?(?P<name>{_ID})\s*{_GEN}[^{{;]*\{{"),
            ("interface", rf"{_MODS}\btrait\s+(?P<name>{_ID})[^{{;]*\{{"),
            ("enum", rf"{_MODS}\benum\s+(?P<name>{_ID})\s*{_GEN}\s*\{{"),
            ("constant", rf"{_MODS}\b(?:const|static)\s+(?P<name>[A-Z][A-Z0-9_]*)\s*:"),
        ),
        quotes='"',
        arrow="|",
        exported="pub",
    ),
    "java": Grammar(
        (
            ("class", rf"{_MODS}\bclass\s+(?P<name>{_ID})\s*{_GEN}(?P<bases>[^{{;]*)\{{"),
            ("interface", rf"{_MODS}\binterface\s+(?P<name>{_ID})\s*{_GEN}(?P<bases>[^{{;]*)\{{"),
            ("enum", rf"{_MODS}\benum\s+(?P<name>{_ID})(?P<bases>[^{{;]*)\{{"),
            ("method", rf"{_MODS}(?:{_GEN}\s*)(?<![\w.])(?!return\b|new\b|else\b|throw\b)[\w.<>\[\],?]+\s+(?P<name>{_ID})\s*(?P<params>\()(?=[^;{{}}()]*(?:\([^)]*\)[^;{{}}()]*)*\)[^;{{}}]*[{{;])"),
            ("property", rf"(?m)^[ \t]*{_MODS}(?!return\b|new\b|package\b|import\b|throw\b)[\w.<>\[\],?]+\s+(?P<name>{_ID})\s*(?:=[^;{{}}]*)?;"),
        ),
        quotes="\"'",
        arrow="->",
        exported="public",
    ),
    "c": Grammar((("class", rf"\b(?:struct|union)\s+(?P<name>{_ID})\s*\{{"), ("enum", rf"\benum\s+(?P<name>{_ID})\s*\{{"), ("typedef", _C_TYPEDEF), ("function", _C_FUNC), ("field", _C_FIELD)), quotes="\"'", exported="*"),
    "cpp": Grammar(
        (("enum", rf"\benum\s+(?:class\s+)?(?P<name>{_ID})[^{{;]*\{{"), ("class", rf"\b(?:class|struct|namespace)\s+(?P<name>{_ID})(?P<bases>[^{{;()]*)\{{"), ("typedef", _C_TYPEDEF), ("function", _C_FUNC), ("field", _C_FIELD)),
        quotes="\"'",
        arrow="[](",
        exported="*",
    ),
    "csharp": Grammar(
        (
            ("class", rf"{_MODS}\b(?:class|struct|record)\s+(?P<name>{_ID})\s*{_GEN}(?P<bases>[^{{;]*)\{{"),
            ("interface", rf"{_MODS}\binterface\s+(?P<name>{_ID})\s*{_GEN}(?P<bases>[^{{;]*)\{{"),
            ("enum", rf"{_MODS}\benum\s+(?P<name>{_ID})[^{{;]*\{{"),
            ("method", rf"{_MODS}(?<![\w.])(?!return\b|new\b|else\b|throw\b|await\b|using\b|namespace\b)(?:[\w.<>\[\],?]+\s+)?(?P<name>[A-Z]\w*)\s*{_GEN}\s*(?P<params>\()(?=[^;{{}}]*\)\s*(?:where[^{{]*)?(?:\{{|=>))"),
            ("property", rf"{_MODS}[\w.<>\[\],?]+\s+(?P<name>{_ID})\s*\{{\s*(?:get|set|init)\b"),
        ),
        quotes="\"'",
        arrow="=>",
        exported="public",
    ),
    "php": Grammar((("class", rf"{_MODS}\bclass\s+(?P<name>{_ID})(?P<bases>[^{{;]*)\{{"), ("interface", rf"\binterface\s+(?P<name>{_ID})(?P<bases>[^{{;]*)\{{"), ("function", rf"{_MODS}\bfunction\s+&?(?P<name>{_ID})\s*(?P<params>\()")), line=r"//|#(?!\[)", quotes="\"'", exported="public"),
    "swift": Grammar((("class", rf"{_MODS}\b(?:class|struct|extension|actor)\s+(?P<name>{_ID})[^{{;()]*\{{"), ("interface", rf"{_MODS}\bprotocol\s+(?P<name>{_ID})[^{{;]*\{{"), ("function", rf"{_MODS}\bfunc\s+(?P<name>{_ID})\s*{_GEN}\s*(?P<params>\()")), quotes='"', exported="public"),
    "kotlin": Grammar((("class", rf"{_MODS}\b(?:class|object)\s+(?P<name>{_ID})[^{{\n]*"), ("interface", rf"{_MODS}\binterface\s+(?P<name>{_ID})[^{{\n]*"), ("function", rf"{_MODS}\bfun\s+{_GEN}\s*(?:{_ID}\.)?(?P<name>{_ID})\s*(?P<params>\()")), quotes='"', exported="!private"),
    "ruby": Grammar((("class", r"(?m)^[ \t]*(?:class|module)\s+(?P<name>[A-Z]\w*)"), ("function", r"(?m)^[ \t]*def\s+(?:self\.)?(?P<name>[a-z_]\w*[?!=]?)(?P<params>\()?")), line="#", quotes="\"'", exported="*", ruby=True),
}
NOT_CALLS = frozenset("if for while switch catch return function sizeof new throw else do await typeof super constructor match fn func def elif and or not with in is import require_relative class struct enum interface foreach using lock when where guard defer async unless until case print_r isset empty array list const var type import package".split())
CALL = re.compile(rf"(?<![\w$])(?P<name>{_ID})\s*{_GEN}\s*\(")
RUBY_WORDS = frozenset("alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo require rescue retry return self super then true undef unless until when while yield".split())
#: A call without brackets: a name and, on the same line, the start of an argument; and a message to an object.
RUBY_COMMAND = re.compile(rf"(?<![\w.:@$])([a-z_]\w*[?!]?)(?=[ \t]+(?!(?:{'|'.join(sorted(RUBY_WORDS - {'nil', 'true', 'false', 'self', 'not', 'defined?'}))})\b)(?::[\w'\"]|[\w'\"@]))")
RUBY_MESSAGE = re.compile(r"(?<=\.)(?<!\.\.)([A-Za-z_]\w*(?:[?!]|(?!\w|[ \t]*\()))")
BLOCK_KINDS = ("class", "interface", "enum", "impl")


SPACE = re.compile(r"\s*")


class Places:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def column(self, offset: int) -> int:
        return offset - self.starts[self.line(offset) - 1]


class Braces:
    """Where each brace closes."""

    def __init__(self, plain: str):
        self.close, stack = {}, []
        self.inner = []  # (place, the bracket that opens around what follows it)
        for m in re.finditer(r"[{}()]", plain):
            if m[0] in "{(":
                stack.append((m[0], m.start()))
            elif stack and stack[-1][0] == {"}": "{", ")": "("}[m[0]]:
                self.close[stack.pop()[1]] = m.start()
            self.inner.append((m.start(), stack[-1][1] if stack else -1))
        self.length = len(plain)

    def holds(self, at: int, openings: set[int]) -> bool:
        """Whether the innermost bracket around a place is one of ``openings``."""
        i = bisect_right(self.inner, (at, -2)) - 1
        return i >= 0 and self.inner[i][1] in openings

    def end(self, at: int) -> int:
        return self.close.get(at, max(at, self.length - 1))


class Around:
    """The last-begun of some intervals (begin, end, value) that hold a place; places are asked for in ascending order.

    One sweep: an interval that is over is dropped from the top of a stack and never looked at again.
    """

    def __init__(self, intervals: list[tuple[int, int, object]]):
        self.waiting, self.open = sorted(intervals, key=lambda x: -x[0]), []

    def __call__(self, place: int) -> object | None:
        while self.waiting and self.waiting[-1][0] < place:
            self.open.append(self.waiting.pop())
        while self.open and self.open[-1][1] < place:
            self.open.pop()
        return self.open[-1][2] if self.open else None


def blank(text: str, line: str, block: tuple[str, str] | None, quotes: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with comments and the insides of strings as spaces, and the comments as (start, end, text); ``line`` is the
    pattern that opens a line comment."""
    parts = [rf"(?:{line})[^\n]*"]
    if block:
        parts.append(re.escape(block[0]) + r"(?s:.*?)" + re.escape(block[1]))
    strings = [rf"{q}(?:\\(?s:.)|[^{q}\\" + ("" if q == "`" else r"\n") + rf"])*{q}" for q in quotes]
    pattern = re.compile("(?P<comment>" + "|".join(parts) + ")|" + "|".join(strings))
    comments, out, at = [], [], 0
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        if m["comment"]:
            comments.append((m.start(), m.end(), m.group()))
            out.append(re.sub(r"[^\n]", " ", m.group()))
        else:
            out.append(m.group()[0] + re.sub(r"[^\n]", " ", m.group()[1:-1]) + m.group()[-1])
        at = m.end()
    out.append(text[at:])
    return "".join(out), comments


def doc_above(comments: list[tuple[int, int, str]], text: str, start: int) -> str | None:
    """The comments that end right above a definition, cleaned; a blank line stops."""
    at = text.rfind("\n", 0, start) + 1
    found: list[str] = []
    for a, b, body in map(comments.__getitem__, range(bisect_right(comments, at, key=lambda c: c[1]) - 1, -1, -1)):
        if text[b:at].strip() or text[b:at].count("\n") > 1 or text[text.rfind("\n", 0, a) + 1 : a].strip():
            break
        if body.startswith("/*"):
            if not found:
                lines = [re.sub(r"^\s*\*\s?", "", x).rstrip() for x in re.sub(r"^/\*+\s?|\s*\*+/$", "", body).split("\n")]
                return "\n".join(lines).strip() or None
            break
        found.insert(0, re.sub(r"^\s*(?:///?!?|#)\s?", "", body).rstrip())
        at = text.rfind("\n", 0, a) + 1
    return "\n".join(found) or None


def _exported(grammar: Grammar, language: str, name: str, mods: str, head: str) -> bool:
    words = set(re.findall(r"\w+", mods))
    if language == "go":
        return name[:1].isupper()
    if grammar.exported == "*":
        return "static" not in words
    if grammar.exported == "!private":
        return "private" not in words
    if language in ("java", "csharp"):
        return bool(words & {"public", "protected"})
    if language == "swift":
        return bool(words & {"public", "open"})
    if language == "php":
        return "private" not in words and "protected" not in words
    return grammar.exported in words or bool(re.search(rf"\b{grammar.exported}\b", head))


def _ruby_end(text: str, start: int) -> int:
    """Where a Ruby block ends: at the next line with ``end`` that is indented no deeper."""
    indent = len(re.match(r"[ \t]*", text[text.rfind("\n", 0, start) + 1 :]).group())
    m = re.compile(rf"^[ \t]{{0,{indent}}}end\b", re.M).search(text, text.find("\n", start) if "\n" in text[start:] else len(text))
    return m.end() if m else len(text)


def _scan(out: Extraction, text: str) -> None:
    grammar = GRAMMARS[out.language]
    plain, comments = blank(text, grammar.line, None if grammar.ruby else ("/*", "*/"), grammar.quotes)
    at, braces = Places(text), Braces(plain)
    found: list[tuple[int, int, int, str, str, re.Match]] = []  # start, end, body start, kind, name, match
    taken: set[int] = set()
    class_bodies: set[int] = set()
    const_groups = {m.end() - 1 for m in re.finditer(r"(?m)^const\s*\(", plain)} if out.language == "go" else set()
    for kind, pattern in grammar.defs:
        for m in re.finditer(pattern, plain):
            if m.start("name") in taken or m["name"] in NOT_CALLS and m["name"] != "constructor":
                continue
            if kind == "constant" and m.re.pattern.startswith("(?m)(?:^const") and not braces.holds(m.start("name"), const_groups):
                continue
            if kind in ("method", "field") and out.language in ("typescript", "javascript", "c", "cpp") and not braces.holds(m.start("name"), class_bodies):
                continue
            start = m.start("name")
            if grammar.ruby:
                body, end = m.end(), _ruby_end(text, m.start("name"))
            else:
                from_ = braces.end(m.start("params")) if m.groupdict().get("params") else m.end() - (m.group().endswith("{"))
                opening = re.compile(r"[{;]|\n\s*\n" if kind in ("function", "method", "class", "interface", "impl", "enum", "arrow") else r";|\n").search(plain, from_)
                body = opening.start() if opening else len(plain)
                end = braces.end(body) if opening and opening.group() == "{" else body
            taken.add(m.start("name"))
            if kind in ("class", "interface"):
                class_bodies.add(body)
            found.append((start, end, body, "property" if kind == "field" else kind, m["name"], m))
    found.sort(key=lambda f: f[0])
    blocks = [f for f in found if f[3] in BLOCK_KINDS]
    owners: list[tuple[int, int, str]] = []
    calling_lines = {at.line(f[0]) for f in found if f[3] in ("arrow", "function")}
    block_around = Around([(b[2], b[1], b) for b in blocks if b[3] != "enum"])
    call_around = Around([(f[0], f[1] - 1, f) for f in found if f[3] in ("function", "method", "arrow")])
    for start, end, body, kind, name, m in found:
        around, inner = block_around(start), call_around(start) is not None
        if kind == "variable" and at.line(start) in calling_lines:
            continue
        mods = m.groupdict().get("mods") or ""
        head = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        owner = m.groupdict().get("owner") or (around[4] if around else None)
        node_kind = {"arrow": "function", "impl": "class", "typedef": "class"}.get(kind, kind)
        if kind in ("function", "arrow") and owner and kind == "function" and not inner:
            node_kind = "method"
        if kind == "variable":
            if around or inner:
                continue
            node_kind = "constant" if name.isupper() else "variable"
        if kind == "property" and (not around or inner):
            continue
        signature = None
        if m.groupdict().get("params"):
            close = braces.end(m.start("params"))
            params = re.sub(r"\s+", " ", text[m.start("params") : close + 1])
            after = re.sub(r"\s+", " ", text[close + 1 : body]).strip()
            ret = None
            if out.language in ("typescript", "javascript", "php", "kotlin"):
                ret = after[1:].strip() if after.startswith(":") else None
            elif out.language in ("rust", "swift"):
                ret = after[2:].split(" where ")[0].strip() if after.startswith("->") else None
            elif out.language == "go":
                ret = after or None
            signature = f"{params} -> {ret}" if ret else params
        words = set(re.findall(r"\w+", mods))
        i = out.add(node_kind, name, at.line(start), at.line(max(start, end)), qualified_name=f"{owner}.{name}" if node_kind == "method" and owner else name, signature=signature, docstring=doc_above(comments, text, m.start() + len(m.group()) - len(m.group().lstrip())), is_exported=_exported(grammar, out.language, name, mods, head), is_async="async" in words or "suspend" in words, is_static="static" in words, is_abstract="abstract" in words, start_column=at.column(start))
        owners.append((start, end, i))
        if kind == "enum":
            inside = plain[body + 1 : end].split(";")[0]
            for e in re.finditer(rf"(?:^|,)\s*(?:\[[^\]]*\]\s*|#\[[^\]]*\]\s*)*({_ID})", inside):
                out.add("enum_member", e[1], at.line(body + 1 + e.start(1)), at.line(body + 1 + e.end(1)), qualified_name=f"{name}.{e[1]}", start_column=at.column(body + 1 + e.start(1)))
    made = {o[0]: o[2] for o in reversed(owners)}
    for start, end, body, kind, name, m in blocks:
        i = made[start]
        line = at.line(start)
        bases = m.groupdict().get("bases") or ""
        if out.language in ("csharp", "cpp"):
            after = bases.split(":", 1)[1] if ":" in bases else ""
            for base in re.split(r",", re.sub(r"\bwhere\b.*", "", after)):
                if names := [w for w in re.findall(r"\w+", re.sub(r"<.*", "", base)) if w not in ("public", "private", "protected", "virtual")]:
                    out.inherit(i, names[-1], "extends", line)
        else:
            for word, listed in re.findall(r"\b(extends|implements)\s+([^{]*?)(?=\bextends\b|\bimplements\b|$)", bases):
                for base in re.split(r",", re.sub(r"<[^<>]*>", "", listed)):
                    if names := re.findall(r"[\w$]+", base):
                        out.inherit(i, names[-1], word, line)
        if m.groupdict().get("trait"):
            out.inherit(i, m["trait"], "implements", line)
        if out.language == "go" and kind == "class":
            for e in re.finditer(r"(?m)^\s*\*?([A-Z]\w*)\s*$", plain[body + 1 : end]):
                out.inherit(i, e[1], "implements", line)
    if grammar.arrow:
        anonymous = {"=>": rf"(?:\([^()]*\)|{_ID})\s*(?::[^=\n(){{}}]+)?=>", "->": rf"(?:\([^()]*\)|{_ID})\s*->", "func(": r"(?<=[^\n])\bfunc\s*\(", "[](": r"\[[^\]\n]*\]\s*\(", "|": r"(?<=[(,={;>])\s*(?:move\s+)?\|[^|;{}]*\|"}[grammar.arrow]
        for m in re.finditer(anonymous, plain):
            opening = SPACE.match(plain, m.end()).end()
            if grammar.arrow in ("func(", "[]("):
                opening = plain.find("{", m.end())
                if opening < 0:
                    continue
            if grammar.arrow == "|" and plain.startswith("->", opening):
                opening = max(opening, plain.find("{", opening))
            if plain[opening : opening + 1] == "{":
                end = braces.end(opening)
            else:
                depth, end = 0, opening
                while end < len(plain) and not (depth == 0 and plain[end] in ",;)\n}"):
                    depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(plain[end], 0)
                    end += 1
            start = m.end() - len(m.group().lstrip())
            line = at.line(start)
            owners.append((start, end, out.add("function", f"anonymous_at_line_{line}", line, at.line(end), start_column=at.column(start))))
    defined = {f[0] for f in found}
    owner_of = Around(owners)
    for m in CALL.finditer(plain):
        source = owner_of(m.start()) or out.file_id
        if m["name"] in NOT_CALLS or m.start("name") in defined or re.search(r"\b(?:func|function|def|fun|fn)\s+$", plain[max(0, m.start() - 12) : m.start()]):
            continue
        if m["name"] == "require":
            spec = re.match(r"""\s*['"]([^'"]+)['"]""", text[m.end() :])
            if spec and spec[1].endswith(BINARY):
                out.ref(source, spec[1], "ffi", at.line(m.start()), at.column(m.start()))
            continue
        out.ref(source, m["name"], "function", at.line(m.start()), at.column(m.start()))
    if grammar.ruby:
        own = {n["name"] for n in out.nodes}
        calls = {m.start(1): m[1] for m in RUBY_COMMAND.finditer(plain) if m[1] not in RUBY_WORDS and m[1] not in NOT_CALLS}
        calls |= {m.start(1): m[1] for m in RUBY_MESSAGE.finditer(plain) if m[1] not in NOT_CALLS}
        calls |= {m.start(1): m[1] for m in re.finditer(r"(?m)(?<![\w.:@])([a-z_]\w*[?!]?)[ \t]*$", plain) if m[1] in own}
        owner_of = Around(owners)
        for start, name in sorted(calls.items()):
            source = owner_of(start) or out.file_id
            if start not in defined and not re.search(r"\bdef\s+(?:\w+\.)?$", plain[max(0, start - 80) : start]):
                out.ref(source, name, "function", at.line(start), at.column(start))
    for a, b, body in comments:
        _comment(out, body, at.line(a), at.line(b))
    _imports(out, text, plain, at)


def _names(listed: str, renamed: str = r"\s+as\s+") -> list[tuple[str, str]]:
    """(local, original) of a list such as ``a, b as c``."""
    out = []
    for item in listed.split(","):
        words = re.split(renamed, re.sub(r"^\s*type\s+", "", item).strip())
        if words[0]:
            out.append((words[-1].strip(), words[0].strip()))
    return out


def _imports(out: Extraction, text: str, plain: str, at: Places) -> None:
    """Import statements: one node each, a reference to the module, and what each local name stands for."""
    code = text
    live = lambda m: plain[m.start() : m.start() + 3].strip() != ""  # noqa: E731  not inside a comment

    def statement(m: re.Match, names: list[tuple[str, str]], module: str, node: bool = True) -> None:
        for local, original in names:
            out.imported(local, original, module)
        if node:
            out.module(names[0][0] if names else module.rsplit("/", 1)[-1], module, at.line(m.start()), at.line(m.end()))

    language = out.language
    if language in ("typescript", "javascript"):
        for m in re.finditer(r"""\b(import|export)\s+(type\s+)?([^'";]*?)\s*\bfrom\s*(['"])([^'"]+)\4|\bimport\s*(['"])([^'"]+)\6""", code):
            if not live(m):
                continue
            if m[7]:
                statement(m, [], m[7])
                continue
            names = []
            for group in re.findall(r"\{([^}]*)\}", m[3]):
                names += _names(group)
            rest = re.sub(r"\{[^}]*\}", "", m[3])
            names += [(n, n) for n in re.findall(rf"\*\s*as\s+({_ID})", rest)]
            default = re.match(rf"\s*({_ID})\s*(?:,|$)", re.sub(r"\*\s*as\s+\S+", "", rest))
            if default and m[1] == "import":
                names.append((default[1], default[1]))
            if m[1] == "export":
                for local, original in names:
                    out.imported(local, original, m[5])
                out.add("export", "export", at.line(m.start()), at.line(m.end()))
                out.ref(out.file_id, m[5], "module", at.line(m.start()))
            else:
                statement(m, names, m[5])
        for m in re.finditer(rf"""\b(?:const|let|var)\s+(?:\{{([^}}]*)\}}|({_ID}))\s*=\s*require\s*\(\s*['"]([^'"]+)['"]""", code):
            if live(m):
                names = [(a, b) for a, b in _names(m[1], r"\s*:\s*")] if m[1] else [(m[2], m[2])]
                statement(m, names, m[3], node=not m[3].endswith(BINARY))
        for m in re.finditer(r"(?m)^\s*export\b", plain):
            if " from " not in code[m.start() : code.find("\n", m.start())]:
                out.add("export", "export", at.line(m.start() + len(m[0]) - len(m[0].lstrip())), at.line(m.end()))
    elif language == "go":
        for m in re.finditer(r"""(?m)^import\s*\(([^)]*)\)|^import\s+([^\n(]+)""", code):
            for alias, module in re.findall(r"""([\w.]+\s+)?["']([^"']+)["']""", m[1] or m[2] or ""):
                local = alias.strip() or module.rsplit("/", 1)[-1]
                statement(m, [(local, local)], module)
    elif language == "java":
        for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", code):
            name = m[1].rsplit(".", 1)[-1]
            statement(m, [(name, name)], m[1].replace(".", "/"))
    elif language == "rust":
        for m in re.finditer(r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+?)(?:::\{([^}]*)\})?(?:\s+as\s+(\w+))?\s*;", code):
            if m[2]:
                statement(m, _names(m[2]), m[1])
            else:
                module, _, name = m[1].rpartition("::")
                statement(m, [(m[3] or name, name)], module or name)
    elif language == "ruby":
        for m in re.finditer(r"""(?m)^\s*require_relative\s+['"]([^'"]+)['"]""", code):
            name = m[1].rsplit("/", 1)[-1].removesuffix(".rb")
            statement(m, [(name, name)], m[1] if m[1].startswith(".") else "./" + m[1])
            # Everything that the file defines is in reach by its own name.
            out.imported("*", "*", m[1])
    elif language == "php":
        for m in re.finditer(r"(?m)^\s*use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", code):
            name = m[1].rsplit("\\", 1)[-1]
            statement(m, [(m[2] or name, name)], m[1].replace("\\", "/"))
    elif language in ("c", "cpp"):
        for m in re.finditer(r"""(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]""", code):
            out.module(m[1].rsplit("/", 1)[-1], ("./" if '"' in m[0] and not m[1].startswith(".") else "") + m[1], at.line(m.start(1)), at.line(m.end()))
    elif language == "csharp":
        for m in re.finditer(r"(?m)^\s*using\s+([\w.]+)\s*;", code):
            out.module(m[1].rsplit(".", 1)[-1], m[1], at.line(m.start(1)), at.line(m.end()))
    elif language in ("swift", "kotlin"):
        for m in re.finditer(r"(?m)^\s*import\s+([\w.]+)", code):
            out.module(m[1].rsplit(".", 1)[-1], m[1], at.line(m.start(1)), at.line(m.end()))
