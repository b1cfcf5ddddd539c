"""Source text to nodes and edges.

Python is parsed with ``ast``; other languages by the lexical rules of ``RULES``: declarations found by patterns,
their extent by braces or indentation, calls as names before a parenthesis. What is reported is the same for all:
a File node, Class and Function (or Test) nodes, and CONTAINS, CALLS and IMPORTS_FROM edges whose call targets are
the callee's text as written. Parsing runs per file in ``mapInArrow``, where the content is read; a file that can't
be parsed is reported by its File node alone.
"""

from __future__ import annotations

import ast
import contextlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import keys
from ..graph import Graph

PARAMS, CALLEE = 500, 200


@dataclass
class Parsed:
    """error says what of a file could not be read, if the rest was."""

    nodes: list[dict]
    edges: list[dict]
    error: str | None = None


def language_of(path: str) -> str:
    return keys.LANGUAGES.get(PurePosixPath(path).suffix.lower(), "")


def is_test(name: str, language: str, path: str) -> bool:
    base = path.rsplit("/", 1)[-1]
    return name.startswith(keys.TEST_PREFIXES.get(language, ("\0",))) or any(m in base for m in keys.TEST_FILE_MARKS)


class _Report:
    """Gathers the rows of one file."""

    def __init__(self, path: str, language: str, lines: int):
        self.path, self.language = path, language
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.node("File", path, 1, max(1, lines))

    def node(self, kind: str, name: str, start: int, end: int, parent: str | None = None, params: str | None = None, returns: str | None = None,
             decorators: list[str] | None = None) -> None:
        extra = {"decorators": json.dumps(decorators)} if decorators else None
        self.nodes.append({
            "kind": kind, "name": name, "file_path": self.path, "line_start": start, "line_end": end, "language": self.language, "parent_name": parent,
            "params": params[:PARAMS] if params else None, "return_type": returns or None, "modifiers": None, "is_test": kind == "Test", "extra": extra})

    def edge(self, kind: str, source: str, target: str, line: int) -> None:
        if target:
            self.edges.append({"kind": kind, "source_qualified": source, "target_qualified": target, "file_path": self.path, "line": line, "extra": None})

    def name_of(self, name: str, parent: str | None = None) -> str:
        return f"{self.path}::{parent}.{name}" if parent else f"{self.path}::{name}"

    def function(self, name: str, start: int, end: int, parent: str | None, params: str | None, returns: str | None, decorators: list[str] | None = None) -> str:
        own = self.name_of(name, parent)
        self.node("Test" if is_test(name, self.language, self.path) else "Function", name, start, end, parent, params, returns, decorators)
        self.edge("CONTAINS", self.name_of(parent) if parent else self.path, own, start)
        return own

    def cls(self, name: str, start: int, end: int, decorators: list[str] | None = None) -> None:
        self.node("Class", name, start, end, decorators=decorators)
        self.edge("CONTAINS", self.path, self.name_of(name), start)

    def call(self, source: str, callee: str, line: int) -> None:
        if 0 < len(callee) < CALLEE:
            self.edge("CALLS", source, callee, line)


# --- Python -------------------------------------------------------------------------------------

class _Python(ast.NodeVisitor):
    def __init__(self, out: _Report):
        self.out = out
        self.parent: str | None = None

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        self.out.cls(n.name, n.lineno, n.end_lineno or n.lineno, [ast.unparse(d) for d in n.decorator_list])
        for base in n.bases:
            self.out.edge("INHERITS", self.out.name_of(n.name), ast.unparse(base), n.lineno)
        before, self.parent = self.parent, n.name
        self.generic_visit(n)
        self.parent = before

    def _function(self, n) -> None:
        own = self.out.function(
            n.name, n.lineno, n.end_lineno or n.lineno, self.parent, f"({ast.unparse(n.args)})", ast.unparse(n.returns) if n.returns else None,
            [ast.unparse(d) for d in n.decorator_list])
        for inner in ast.walk(n):  # calls of nested functions count for the outer one, too
            if isinstance(inner, ast.Call):
                self.out.call(own, ast.unparse(inner.func), inner.lineno)
        self.generic_visit(n)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_Import(self, n: ast.Import) -> None:
        for a in n.names:
            self.out.edge("IMPORTS_FROM", self.out.path, a.name, n.lineno)

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        self.out.edge("IMPORTS_FROM", self.out.path, "." * n.level + (n.module or ""), n.lineno)


# --- other languages ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Rules:
    """Patterns; LIST in that of functions stands for a list in parentheses."""

    classes: str
    functions: str
    imports: tuple[str, ...]
    comments: str = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    braces: bool = True


#: A list in parentheses, with lists of up to two levels in it; what was read once is not tried again.
_LIST = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_C_LIKE = r"^[ \t]*(?:[\w:<>,\[\]*&~.?]+[ \t]+)+[*&]*(?P<name>~?[A-Za-z_]\w*(?:::~?\w+)*)[ \t]*(?P<params>LIST)[^;{}()]*\{"
_JS = (r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*(?P<name>[\w$]+)[ \t]*(?P<params>LIST)"
       r"|^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name2>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]+)?(?P<params2>LIST|[\w$]+)[^=\n]*=>"
       r"|^[ \t]+(?:(?:public|private|protected|static|async|get|set|override)[ \t]+)*(?P<name3>[\w$#]+)[ \t]*(?P<params3>LIST)[^;{}()=]*\{")
_JS_IMPORT = (r"""\bimport\b[^;'"]*['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]""", r"""\bexport\b[^;'"]*\bfrom\s*['"]([^'"]+)['"]""")
_JS_RULES = Rules(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?(?:class|interface)[ \t]+(?P<name>[\w$]+)", _JS, _JS_IMPORT)
_HASH = r"#[^\n]*"

RULES = {
    "go": Rules(r"^type[ \t]+(?P<name>\w+)[ \t]+(?:struct|interface)\b", r"^func[ \t]*(?:\([^)]*\)[ \t]*)?(?P<name>\w+)[ \t]*(?:\[[^\]]*\])?(?P<params>LIST)(?P<ret>[^{}\n]*)\{",
                (r'^import[ \t]+(?:[\w.]+[ \t]+)?"([^"]+)"', r'^[ \t]+(?:[\w.]+[ \t]+)?"([^"\s]+)"[ \t]*$')),
    "rust": Rules(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:struct|enum|trait|impl(?:<[^>]*>)?(?:[ \t]+[\w:<>, ]+[ \t]+for)?)[ \t]+(?P<name>\w+)",
                  r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:const[ \t]+|async[ \t]+|unsafe[ \t]+)*fn[ \t]+(?P<name>\w+)(?:<[^>]*>)?(?P<params>LIST)(?P<ret>[^{};]*)\{",
                  (r"^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;]+);",)),
    "java": Rules(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)[ \t]+)*(?:class|interface|enum|record)[ \t]+(?P<name>\w+)", _C_LIKE,
                  (r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+);",)),
    "csharp": Rules(r"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)[ \t]+)*(?:class|interface|struct|record|enum)[ \t]+(?P<name>\w+)", _C_LIKE,
                    (r"^[ \t]*using[ \t]+([\w.]+);",)),
    "c": Rules(r"^[ \t]*(?:typedef[ \t]+)?(?:struct|union|enum)[ \t]+(?P<name>\w+)[ \t]*\{", _C_LIKE, (r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]',)),
    "cpp": Rules(r"^[ \t]*(?:class|struct|union|enum(?:[ \t]+class)?)[ \t]+(?P<name>\w+)[^;(){}]*\{", _C_LIKE, (r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]',)),
    "kotlin": Rules(r"^[ \t]*(?:\w+[ \t]+)*(?:class|interface|object)[ \t]+(?P<name>\w+)", r"^[ \t]*(?:\w+[ \t]+)*fun[ \t]+(?:<[^>]*>[ \t]*)?(?:[\w.]+\.)?(?P<name>\w+)[ \t]*(?P<params>LIST)",
                    (r"^[ \t]*import[ \t]+([\w.*]+)",)),
    "swift": Rules(r"^[ \t]*(?:\w+[ \t]+)*(?:class|struct|enum|protocol|extension)[ \t]+(?P<name>\w+)", r"^[ \t]*(?:[\w@]+[ \t]+)*func[ \t]+(?P<name>\w+)[^({]*(?P<params>LIST)",
                   (r"^[ \t]*import[ \t]+(?:\w+[ \t]+)?([\w.]+)",)),
    "php": Rules(r"^[ \t]*(?:(?:abstract|final)[ \t]+)*(?:class|interface|trait)[ \t]+(?P<name>\w+)", r"^[ \t]*(?:\w+[ \t]+)*function[ \t]+&?(?P<name>\w+)[ \t]*(?P<params>LIST)",
                 (r"^[ \t]*use[ \t]+([\w\\]+)", r"""\b(?:require|include)(?:_once)?[ \t(]+['"]([^'"]+)""")),
    "scala": Rules(r"^[ \t]*(?:\w+[ \t]+)*(?:class|object|trait)[ \t]+(?P<name>\w+)", r"^[ \t]*(?:\w+[ \t]+)*def[ \t]+(?P<name>\w+)[^(={\n]*(?P<params>LIST)?",
                   (r"^[ \t]*import[ \t]+([\w.{}, _=>]+)",)),
    "ruby": Rules(r"^[ \t]*(?:class|module)[ \t]+(?P<name>[\w:]+)", r"^[ \t]*def[ \t]+(?:self\.)?(?P<name>[\w?!=]+)[ \t]*(?P<params>\([^)]*\))?",
                  (r"""^[ \t]*require(?:_relative)?[ \t(]+['"]([^'"]+)""",), _HASH, False),
    "lua": Rules(r"(?!)", r"^[ \t]*(?:local[ \t]+)?function[ \t]+(?P<name>[\w.:]+)[ \t]*(?P<params>\([^)]*\))", (r"""\brequire[ \t(]+['"]([^'"]+)""",), r"--[^\n]*", False),
    "bash": Rules(r"(?!)", r"^[ \t]*(?:function[ \t]+)?(?P<name>[\w-]+)[ \t]*\(\)[ \t]*\{", (r"^[ \t]*(?:source|\.)[ \t]+([^\s;]+)",), _HASH),
    "javascript": _JS_RULES, "typescript": _JS_RULES, "tsx": _JS_RULES,
}
_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*!?)\s*\(")
_NO_CALL = frozenset("if for while switch catch return function func fn def sizeof typeof new match when elif and or not in do else await super using lock foreach".split())
_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


class _Places:
    """Where lines, blocks and statements of a text begin and end, found in one pass each."""

    def __init__(self, bare: str, braces: bool):
        self.bare, self.braces = bare, braces
        find = lambda pattern: [m.start() for m in re.finditer(pattern, bare)]
        self.lines = find("\n")
        self.opens, self.stops = find(r"\{"), find(";")
        self.closed: dict[int, int] = {}
        pending: list[int] = []
        for m in re.finditer(r"[{}]", bare):
            if m[0] == "{":
                pending.append(m.start())
            elif pending:
                self.closed[pending.pop()] = m.end()
        self.unclosed = pending
        self.ends: dict[str, list[tuple[int, int]]] = {}
        for m in re.finditer(r"^([ \t]*)end\b[^\n]*", bare, re.M) if not braces else ():
            self.ends.setdefault(m[1], []).append(m.span())

    @staticmethod
    def _from(places: list[int], at: int) -> int | None:
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def end(self, at: int, start: int) -> int:
        """Where the block that a declaration opens ends: at its closing brace, or its end line by indentation. A
        block that never closes ends where the next such block begins."""
        if self.braces:
            i, stop = self._from(self.opens, at), self._from(self.stops, at)
            if i is None or (stop is not None and stop < i):
                line = self._from(self.lines, at)
                return len(self.bare) if line is None else line
            if i in self.closed:
                return self.closed[i]
            return self._from(self.unclosed, i + 1) or len(self.bare)
        line = self.lines[k - 1] + 1 if (k := bisect_left(self.lines, start)) else 0
        own = self.ends.get(re.compile(r"[ \t]*").match(self.bare, line)[0], [])
        k = bisect_left(own, (at, 0))
        return own[k][1] if k < len(own) else len(self.bare)


def _lexical(out: _Report, source: str, rules: Rules) -> None:
    code = re.sub(rules.comments, _blank, source, flags=re.S)
    bare = _STRING.sub(_blank, code)
    places = _Places(bare, rules.braces)
    spans, known = [], set()
    for m in re.finditer(rules.classes, bare, re.M):
        end = places.end(m.end() - (bare[m.end() - 1] == "{"), m.start("name"))
        spans.append((m.start(), end, m["name"]))
        if m["name"] not in known:
            known.add(m["name"])
            out.cls(m["name"], places.line(m.start("name")), places.line(max(m.start(), end - 1)))
    around: list[tuple[int, int, str]] = []  # the classes that hold the place, innermost last
    next_class = iter([*spans, (len(bare) + 1, 0, "")])
    ahead = next(next_class)
    found = list(re.finditer(rules.functions.replace("LIST", _LIST), bare, re.M))
    for m, after in zip(found, [*(m.start() for m in found[1:]), len(bare)]):
        groups = m.groupdict()
        which = next((s for s in ("", "2", "3") if groups.get(f"name{s}")), None)
        if which is None or groups[f"name{which}"] in _NO_CALL:
            continue
        name = groups[f"name{which}"]
        where = m.start(f"name{which}")
        end = places.end(m.end() - (bare[m.end() - 1] == "{"), where)
        end = after if not rules.braces and end == len(bare) else end  # without an end line it goes to the next one
        while ahead[0] <= where:
            around.append(ahead)
            ahead = next(next_class)
        while around and around[-1][1] <= where:
            around.pop()
        parent = around[-1][2] if around else None
        span = m.span(f"params{which}") if groups.get(f"params{which}") else (0, 0)
        own = out.function(name, places.line(where), places.line(max(where, end - 1)), parent, code[slice(*span)] or None, (groups.get("ret") or "").strip())
        for c in _CALL.finditer(bare, m.end(), end):
            if c[1].rsplit(".", 1)[-1] not in _NO_CALL:
                out.call(own, c[1], places.line(c.start(1)))
    seen = set()
    for pattern in rules.imports:
        for m in re.finditer(pattern, code, re.M):
            if (m[1].strip(), places.line(m.start(1))) not in seen:
                seen.add((m[1].strip(), places.line(m.start(1))))
                out.edge("IMPORTS_FROM", out.path, m[1].strip(), places.line(m.start(1)))


def parse(path: str, content: bytes) -> Parsed:
    """The nodes and edges of one file; ValueError for a language without rules."""
    language = language_of(path)
    if language != "python" and language not in RULES:
        raise ValueError(f"{path}: no rules for its language")
    source = content.decode("utf-8", "replace")
    out = _Report(path, language, source.count("\n") + (not source.endswith("\n")))
    if language == "python":
        wrong = _python(out, source)
    else:
        wrong = _lexical(out, source, RULES[language])
    return Parsed(out.nodes, out.edges, wrong)


def _python(out: _Report, source: str) -> str | None:
    """Reads a Python file; one that doesn't parse as a whole statement by statement, as far as these do. Returns the
    place of the first that doesn't."""
    def read(text: str, first: int = 0) -> None:
        known = len(out.nodes), len(out.edges)
        try:
            _Python(out).visit(ast.increment_lineno(ast.parse(text), first))
        except (SyntaxError, ValueError, RecursionError):
            del out.nodes[known[0]:], out.edges[known[1]:]
            raise

    try:
        return read(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        wrong = f"{out.path}:{getattr(e, 'lineno', None) or 1}: {type(e).__name__}: {getattr(e, 'msg', None) or e}"
    lines = source.split("\n")
    # A statement begins in the first column, but for what goes on with the one before: else, a bracket, a decorated name.
    begins = [i for i, line in enumerate(lines) if line[:1] not in ("", " ", "\t", "#", ")", "]", "}") and not re.match(r"(?:elif|else|except|finally)\b", line)
              and not (i and lines[i - 1].startswith("@"))]
    for i, j in zip(begins, [*begins[1:], len(lines)]):
        with contextlib.suppress(SyntaxError, ValueError, RecursionError):
            read("\n".join(lines[i:j]), i)
    return wrong


# --- Spark --------------------------------------------------------------------------------------

_MAP = pa.map_(pa.string(), pa.string())
_NODE = pa.struct([("kind", pa.string()), ("name", pa.string()), ("file_path", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()),
                   ("language", pa.string()), ("parent_name", pa.string()), ("params", pa.string()), ("return_type", pa.string()), ("modifiers", pa.string()),
                   ("is_test", pa.bool_()), ("extra", _MAP)])
_EDGE = pa.struct([("kind", pa.string()), ("source_qualified", pa.string()), ("target_qualified", pa.string()), ("file_path", pa.string()), ("line", pa.int32()),
                   ("extra", _MAP)])
_SCHEMA = pa.schema([("file_path", pa.string()), ("file_hash", pa.string()), ("nodes", pa.list_(_NODE)), ("edges", pa.list_(_EDGE)), ("error", pa.string())])
_DDL = ("file_path string, file_hash string, "
        "nodes array<struct<kind:string,name:string,file_path:string,line_start:int,line_end:int,language:string,parent_name:string,params:string,"
        "return_type:string,modifiers:string,is_test:boolean,extra:map<string,string>>>, "
        "edges array<struct<kind:string,source_qualified:string,target_qualified:string,file_path:string,line:int,extra:map<string,string>>>, error string")


#: Nodes and edges that are sent back at once.
ROWS = 5000


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for path, content, digest in zip(*(batch.column(c).to_pylist() for c in range(3))):
            try:
                p = parse(path, content or b"")
                error = p.error
            except ValueError as e:
                p, error = Parsed([], []), str(e)
            for row in (*p.nodes, *p.edges):
                row["extra"] = list(row["extra"].items()) if row["extra"] else None
            rows.append(dict(file_path=path, file_hash=digest, nodes=p.nodes, edges=p.edges, error=error))
            held += 1 + len(p.nodes) + len(p.edges)
            if held >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def parse_files(files: DataFrame, partitions: int = Settings.from_env().parse_partitions) -> DataFrame:
    """(file_path, content, file_hash) -> (file_path, file_hash, nodes, edges, error), a row per file. ``partitions``
    deals files out anew where they come in too few partitions for the work that parsing is; 0 leaves them."""
    files = files.select("file_path", "content", "file_hash")
    return (files.repartition(partitions) if partitions else files).mapInArrow(_parse, _DDL)


def parsed_graph(parsed: DataFrame) -> Graph:
    """The graph of parsed files. Of one file's nodes with equal names the last one counts; edges are kept as they are."""
    rows = parsed.select("file_hash", F.posexplode("nodes").alias("seq", "n")).select("seq", "file_hash", "n.*")
    name = keys.qualified_name(F.col("kind"), F.col("name"), F.col("file_path"), F.col("parent_name"))
    rows = rows.withColumn("qualified_name", name)
    latest = rows.groupBy("qualified_name").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "qualified_name"]), "seq").alias("r"))
    nodes = latest.select(
        keys.stable_id(F.col("qualified_name")).alias("id"), "r.kind", "r.name", "qualified_name", "r.file_path", "r.line_start", "r.line_end", "r.language",
        "r.parent_name", "r.params", "r.return_type", "r.modifiers", "r.is_test", "r.file_hash", "r.extra", F.current_timestamp().alias("updated_at"),
        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("long").alias("community_id"))
    edges = parsed.select(F.explode("edges").alias("e")).select("e.*")
    edges = edges.select(
        keys.stable_id(F.concat_ws("|", "kind", "source_qualified", "target_qualified", "file_path", F.col("line").cast("string"))).alias("id"),
        "kind", "source_qualified", "target_qualified", "file_path", "line", "extra", F.current_timestamp().alias("updated_at"))
    return Graph(nodes, edges)
