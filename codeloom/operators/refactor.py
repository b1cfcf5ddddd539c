"""Rename previews, dead code, suggestions, and applying a stored preview to files."""

from __future__ import annotations

import re
import time
import uuid
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys
from ..graph import Graph
from .basic import file_pattern, keyword_filter
from .joins import large

#: Kinds of inbound edges that keep a symbol alive.
LIVE_KINDS = ("CALLS", "TESTED_BY", "IMPORTS_FROM", "REFERENCES")
PREVIEW_SECONDS = 600


def dead_code(g: Graph, kind: str | None = None, pattern: str | None = None) -> DataFrame:
    """Functions and classes (or nodes of ``kind``) that nothing calls, tests, imports or refers to, other than tests,
    entries by name and symbols with a framework's decorator."""
    rows = g.nodes.filter(F.col("kind") == kind if kind else F.col("kind").isin("Function", "Class"))
    if pattern:
        rows = rows.filter(file_pattern(pattern))
    rows = rows.filter(~F.col("is_test") & ~keys.is_entry_name(F.col("name")))
    rows = rows.filter(~keys.has_framework_decorator(keys.decorators_of(F.col("extra"))))
    live = g.edges_of(*LIVE_KINDS).select(F.col("target_qualified").alias("qualified_name"))
    return rows.join(large(live), "qualified_name", "left_anti")


def suggest_moves(g: Graph) -> DataFrame:
    """(qualified_name, community_id, target_community): functions all of whose callers with a community are in one
    other community."""
    own = g.nodes.filter("kind = 'Function' and community_id is not null").select("qualified_name", "community_id")
    callers = g.edges_of("CALLS").select("source_qualified", F.col("target_qualified").alias("qualified_name"))
    where = g.nodes.filter("community_id is not null").select(F.col("qualified_name").alias("source_qualified"), F.col("community_id").alias("c"))
    # The least and the greatest community of the callers tell whether they are one.
    per = callers.join(large(where), "source_qualified").groupBy("qualified_name").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    return own.join(large(per.filter("low = high")), "qualified_name").filter("low <> community_id").select(
        "qualified_name", "community_id", F.col("low").alias("target_community"))


def suggestions(g: Graph) -> DataFrame:
    """(type, qualified_name, detail): removals of dead symbols and moves."""
    remove = dead_code(g).select(F.lit("remove").alias("type"), "qualified_name", F.lit("no inbound references").alias("detail"))
    move = suggest_moves(g).select(
        F.lit("move").alias("type"), "qualified_name", F.concat(F.lit("to community "), F.col("target_community").cast("string")).alias("detail"))
    return remove.unionByName(move)


def rename_target(g: Graph, old_name: str) -> DataFrame:
    """The one node that ``old_name`` means: the first keyword hit of exactly that name, else the first hit."""
    hit = keyword_filter(old_name)
    rows = g.nodes.filter(F.lit(False) if hit is None else hit)
    return rows.orderBy((F.col("name") == old_name).desc(), "qualified_name").limit(1)


def rename_edits(g: Graph, old_name: str, new_name: str) -> DataFrame:
    """(file_path, line, old, new, confidence): the definition, and call and import sites; one edit a line."""
    target = rename_target(g, old_name).select("qualified_name", "name", "file_path", "line_start")
    definition = target.select("file_path", F.col("line_start").alias("line"), "name", F.lit(0).alias("rank"))
    sites = g.edges_of("CALLS", "IMPORTS_FROM").select(F.col("target_qualified").alias("qualified_name"), F.col("file_path").alias("fp"), "line", "kind")
    sites = sites.join(target.select("qualified_name", "name"), "qualified_name")
    sites = sites.select(F.col("fp").alias("file_path"), "line", "name", F.when(F.col("kind") == "CALLS", 1).otherwise(2).alias("rank"))
    first = F.row_number().over(W.partitionBy("file_path", "line").orderBy("rank"))
    rows = definition.unionByName(sites).withColumn("n", first).filter("n = 1")
    return rows.select("file_path", "line", F.col("name").alias("old"), F.lit(new_name).alias("new"), F.lit("high").alias("confidence"))


def edit_stats(edits: DataFrame) -> DataFrame:
    """(confidence, n): how many edits there are of each confidence."""
    return edits.groupBy("confidence").agg(F.count("*").alias("n"))


# --- applying, on the driver --------------------------------------------------------------------

@dataclass
class Preview:
    id: str
    old: str
    new: str
    edits: list[tuple[str, int]]
    made: float = field(default_factory=time.time)
    stats: dict[str, int] = field(default_factory=dict)


class Refactorings:
    """Previews that wait to be applied, for PREVIEW_SECONDS. A preview's edits are read to the driver, which edits
    the files: they are as many as one symbol has sites."""

    def __init__(self, clock=time.time):
        self.pending: dict[str, Preview] = {}
        self.clock = clock

    def _expire(self) -> None:
        now = self.clock()
        self.pending = {k: p for k, p in self.pending.items() if now - p.made <= PREVIEW_SECONDS}

    def preview(self, g: Graph, old_name: str, new_name: str) -> Preview:
        self._expire()
        rows = rename_edits(g, old_name, new_name).orderBy("file_path", "line").collect()
        if not rows:
            raise LookupError(f"no node is called {old_name}")
        own = Preview(uuid.uuid4().hex[:8], rows[0].old, new_name, [(r.file_path, r.line) for r in rows], self.clock(), dict(Counter(r.confidence for r in rows)))
        self.pending[own.id] = own
        return own

    def apply(self, preview_id: str, root: str | Path, dry_run: bool = False) -> dict:
        """Replaces the old name once per edit: on its line, else at its first place in the file."""
        self._expire()
        own = self.pending.get(preview_id)
        if own is None:
            raise LookupError(f"no preview {preview_id}, or it has expired")
        base = Path(root).resolve()
        changed, errors = [], []
        by_file: dict[str, list[int]] = {}
        for path, line in own.edits:
            by_file.setdefault(path, []).append(line)
        name = re.compile(rf"(?<!\w){re.escape(own.old)}(?!\w)")
        for path, lines in sorted(by_file.items()):
            full = (base / path).resolve()
            if not full.is_relative_to(base):
                errors.append(f"{path}: outside of the root")
                continue
            if not full.is_file():
                errors.append(f"{path}: no such file")
                continue
            text = full.read_text().split("\n")
            for line in lines:
                if 0 < line <= len(text) and name.search(text[line - 1]):
                    text[line - 1] = name.sub(own.new, text[line - 1], count=1)
                elif name.search("\n".join(text)):
                    text = name.sub(own.new, "\n".join(text), count=1).split("\n")
            changed.append(path)
            if not dry_run:
                full.write_text("\n".join(text))
        if not dry_run and not errors:
            del self.pending[preview_id]
        return {"files": changed, "errors": errors, "dry_run": dry_run}
