"""Source files: listing, reading and filtering a working tree."""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import keys
from ..operators.basic import IGNORE_PATTERNS, is_binary, is_ignored

GIT_SECONDS = Settings.from_env().git_seconds
#: Besides letters and digits, what names of revisions are written with: refs, ancestors (~ ^), reflogs (@ { }).
REF_SIGNS = set("-._/~^@{}")


def is_safe_ref(ref: str) -> bool:
    """Whether a string may be passed to git as a revision: no option, and no sign that means something elsewhere."""
    return ref != "" and ref[0] != "-" and all(c in REF_SIGNS or c.isascii() and c.isalnum() for c in ref)


def _git(root: str | Path, *args: str) -> str | None:
    try:
        run = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, timeout=GIT_SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout if run.returncode == 0 else None


def repo_root(start: str | Path = ".", override: str | None = None) -> Path | None:
    """The folder upward of ``start`` that holds .git."""
    if override:
        return Path(override).resolve()
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / ".git").exists()), None)


def project_root(start: str | Path = ".", override: str | None = None) -> Path:
    return repo_root(start, override) or Path(start).resolve()


def tracked_files(root: str | Path, submodules: bool = False) -> list[str]:
    """Tracked files; links are none."""
    if submodules:  # for which git doesn't tell the kinds of entries
        paths = [x for x in (_git(root, "ls-files", "-z", "--recurse-submodules") or "").split("\0") if x]
        return [p for p in paths if not os.path.islink(os.path.join(root, p))]
    rows = (x.partition("\t") for x in (_git(root, "ls-files", "-z", "--stage") or "").split("\0") if x)
    return [path for about, _, path in rows if not about.startswith("120000")]


def walked_files(root: str | Path) -> list[str]:
    """Files of a local tree, links left out, and folders that are always ignored."""
    skipped = {p[:-3] for p in IGNORE_PATTERNS if p.endswith("/**") and "/" not in p[:-3]}
    out = []
    for where, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d not in skipped]
        out += [os.path.relpath(os.path.join(where, n), root) for n in names if not os.path.islink(os.path.join(where, n))]
    return out


def changed_since(root: str | Path, base: str = "HEAD~1") -> list[str]:
    if not is_safe_ref(base):
        return []
    out = _git(root, "diff", "--name-only", base, "--")
    out = _git(root, "diff", "--name-only", "--cached") if out is None else out
    return [x for x in (out or "").splitlines() if x]


def parse_status(lines: list[str]) -> list[str]:
    """Paths of ``git status --porcelain`` lines; of a rename the new one."""
    return [line[3:].split(" -> ")[-1].strip('"') for line in lines if len(line) > 3]


def uncommitted(root: str | Path) -> list[str]:
    return parse_status((_git(root, "status", "--porcelain") or "").splitlines())


def branch_info(root: str | Path) -> tuple[str, str]:
    return tuple((_git(root, "rev-parse", *args) or "").strip() for args in (("--abbrev-ref", "HEAD"), ("HEAD",)))


def ignore_patterns(root: str | Path, name: str = ".codeloomignore") -> tuple[str, ...]:
    """The fixed patterns and those of the tree's ignore file."""
    path = Path(root) / name
    lines = path.read_text().splitlines() if path.exists() else []
    return (*IGNORE_PATTERNS, *(x.strip() for x in lines if x.strip() and not x.strip().startswith("#")))


def _wanted(path, patterns: tuple[str, ...]):
    return ~is_ignored(path, patterns) & (keys.detect_language(path) != "")


def _parsed_rows(found: DataFrame) -> DataFrame:
    rows = found.withColumn("language", keys.detect_language(F.col("file_path"))).filter(~is_binary(F.col("content")))
    return rows.select("file_path", "content", F.sha2("content", 256).alias("file_hash"), "language")


def _relative(base: str):
    uri = base if re.match(r"^\w+://", base) else os.path.abspath(base)
    return F.regexp_replace("path", f"^.*?{re.escape(uri)}/", "")


def read_sources(spark: SparkSession, root: str, patterns: tuple[str, ...] = IGNORE_PATTERNS, listed: list[str] | None = None) -> DataFrame:
    """(file_path, content, file_hash, language): files of a known language that are neither ignored nor binary,
    with paths relative to the root; only those listed, if a list is given. A binaryFile scan of the whole tree, for
    full builds: names of files that no language has are left out before any content is read."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _known_names()).load(base)
    rows = found.select(_relative(base).alias("file_path"), "content").filter(_wanted(F.col("file_path"), patterns))
    if listed is not None:
        rows = rows.join(spark.createDataFrame([(p,) for p in listed], "file_path string"), "file_path", "left_semi")
    return _parsed_rows(rows)


def _known_names() -> str:
    """A glob of the names of files in known languages, in small and capital letters."""
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*{" + ",".join(either(e) for e in keys.LANGUAGES) + "}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file, and not a link, of that path."""
    if not re.match(r"^\w+:", path):
        return os.path.isfile(path) and not os.path.islink(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_files(spark: SparkSession, root: str, paths: list[str], patterns: tuple[str, ...] = IGNORE_PATTERNS) -> DataFrame:
    """The same of the files with the given paths that are there: no other file of the tree is listed or read."""
    base = root.rstrip("/")
    named = spark.createDataFrame([(p,) for p in paths], "file_path string")
    wanted = [r.file_path for r in named.filter(_wanted(F.col("file_path"), patterns)).distinct().collect()]  # paths that were given
    there = [f"{base}/{p}" for p in wanted if exists(spark, f"{base}/{p}")]
    if not there:
        return spark.createDataFrame([], "file_path string, content binary, file_hash string, language string")
    # A path may hold signs of a glob.
    found = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in there])
    return _parsed_rows(found.select(_relative(base).alias("file_path"), "content"))
