"""Column functions over names, paths and keys: all built-in expressions, no Python at run time."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
    ".java": "java", ".cs": "csharp", ".rb": "ruby", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".kt": "kotlin", ".swift": "swift", ".php": "php", ".scala": "scala", ".sol": "solidity", ".vue": "vue", ".dart": "dart", ".r": "r",
    ".mjs": "javascript", ".astro": "typescript", ".pl": "perl", ".pm": "perl", ".lua": "lua", ".sh": "bash", ".bash": "bash",
    ".zsh": "bash", ".ex": "elixir", ".exs": "elixir",
}
TEST_PREFIXES = {
    "python": ("test_", "Test"), "javascript": ("test", "it(", "describe("), "typescript": ("test", "it(", "describe("),
    "tsx": ("test", "it(", "describe("), "go": ("Test", "Benchmark"), "rust": ("test_",), "java": ("test",), "csharp": ("Test",),
    "ruby": ("test_",), "kotlin": ("test",), "swift": ("test",), "php": ("test",),
}
TEST_FILE_MARKS = ("_test.", ".test.", ".spec.", "test_")
SECURITY_KEYWORDS = (
    "auth", "login", "password", "token", "session", "crypt", "secret", "credential", "permission", "sql", "query", "execute", "connect",
    "socket", "request", "http", "sanitize", "validate", "encrypt", "decrypt", "hash", "sign", "verify", "admin", "privilege",
)
DECORATOR_PATTERNS = (
    r"(?i)app\.(get|post|put|delete|patch|route|websocket)", r"(?i)router\.(get|post|put|delete|patch|route)",
    r"(?i)blueprint\.(route|before_request|after_request)", r"(?i)click\.(command|group)", r"(?i)celery\.(task|shared_task)",
    r"(?i)api_view", r"(?i)\baction\b", r"(?i)@(Get|Post|Put|Delete|Patch|RequestMapping)",
)
ENTRY_NAME_PATTERN = r"^main$|^__main__$|^test_|^Test[A-Z]|^on_|^handle_"


def qualified_name(kind: Column, name: Column, file_path: Column, parent: Column) -> Column:
    return F.when(kind == "File", file_path).when(
        F.coalesce(parent, F.lit("")) != "", F.concat(file_path, F.lit("::"), parent, F.lit("."), name)
    ).otherwise(F.concat(file_path, F.lit("::"), name))


def stable_id(key: Column) -> Column:
    """The same key has the same id in every build."""
    return F.xxhash64(key)


def sanitize(text: Column, most: int = 256) -> Column:
    """Without control characters other than tab and newline, cut to ``most`` characters (0: not cut)."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", "")
    return F.substring(clean, 1, most) if most else clean


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))


def detect_language(path: Column) -> Column:
    """The language of a file by its extension; empty if unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(""))


def is_test_function(name: Column, language: Column, path: Column) -> Column:
    by_name = [(language == lang) & name.startswith(p) for lang, prefixes in TEST_PREFIXES.items() for p in prefixes]
    by_file = [basename(path).contains(mark) for mark in TEST_FILE_MARKS]
    return reduce(or_, by_name + by_file)


def is_entry_name(name: Column) -> Column:
    return name.rlike(ENTRY_NAME_PATTERN)


def has_framework_decorator(decorators: Column) -> Column:
    """decorators: array of strings; null counts as none."""
    hit = F.exists(decorators, lambda d: reduce(or_, [d.rlike(p) for p in DECORATOR_PATTERNS]))
    return F.coalesce(hit, F.lit(False))


def decorators_of(extra: Column) -> Column:
    """The decorators entry of ``extra``: a JSON list, or one string."""
    own = F.try_element_at(extra, F.lit("decorators"))
    return F.when(own.startswith("["), F.from_json(own, "array<string>")).when(own.isNotNull(), F.array(own))


def is_security_relevant(name: Column, qualified: Column) -> Column:
    words = "|".join(SECURITY_KEYWORDS)
    return F.lower(name).rlike(words) | F.lower(qualified).rlike(words)


def slugify(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, 80), "-+$", "")
    return F.when(slug == "", "unnamed").otherwise(slug)


def node_text(kind: Column, name: Column, parent: Column, params: Column, returns: Column, language: Column) -> Column:
    """What an embedding of a node is made from."""
    some = lambda c, before="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c))
    return F.concat_ws(" ", name, F.when(kind != "File", F.lower(kind)), some(parent, "in "), some(params), some(returns, "returns "), some(language))


def module_of(path: Column) -> Column:
    """The dotted name of a file; without .py."""
    return F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), r"\.py$", "")


def path_suffixes(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    every = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
    return F.filter(every, lambda s: s != "")
