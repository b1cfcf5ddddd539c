"""Commands: ``python -m codeloom.cli build --root . --store /shared/graph`` and so on."""

from __future__ import annotations

import argparse
import sys
import tempfile
import threading
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import Settings
from .operators import community
from .operators.store import GraphStore
from .plans import tools
from .session import session
from .sources import files as tree
from .sources.registry import Registry
from .streaming import watch as watching


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description="Code knowledge graphs on Spark.")
    p.add_argument("--root", default=None, help="the source tree; CODELOOM_ROOT, else the one around the working folder, by default")
    p.add_argument("--store", default=None, help="where the graph's tables are; CODELOOM_DATA_DIR, else .codeloom in the tree, by default")
    p.add_argument("--registry", default=str(Path.home() / ".codeloom" / "repos.json"))
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("version", "build", "status", "postprocess", "repos"):
        sub.add_parser(name)
    for name in ("update", "detect-changes"):
        sub.add_parser(name).add_argument("--base", default="HEAD~1")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--kind")
    s.add_argument("--limit", type=int, default=20)
    sub.add_parser("visualize").add_argument("--out", default="graph.html")
    sub.add_parser("wiki").add_argument("--out", default="wiki")
    w = sub.add_parser("watch")
    w.add_argument("events", nargs="?", help="a folder where file events land as JSON lines; without it the tree itself is followed")
    w.add_argument("--once", action="store_true")
    r = sub.add_parser("register")
    r.add_argument("path")
    r.add_argument("--alias", default="")
    sub.add_parser("unregister").add_argument("path")
    return p


def _show(rows: DataFrame, most: int = 100) -> None:
    for r in rows.limit(most).collect():
        print("\t".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command in ("register", "unregister", "repos"):
        registry = Registry(a.registry)
        if a.command == "register":
            registry.register(a.path, a.alias)
        elif a.command == "unregister" and not registry.unregister(a.path):
            print(f"{a.path} isn't registered", file=sys.stderr)
            return 1
        for r in registry.list():
            print(r["path"], r.get("alias", ""), sep="\t")
        return 0
    settings = Settings.from_env()
    root = str(tree.project_root(a.root or settings.root or "."))
    spark = spark or session()
    c = tools.Context(spark, GraphStore(spark, a.store or settings.store_path(root)), root, settings=settings)
    c.store.migrate()
    if a.command == "build":
        print(tools.build_or_update_graph(c, full_rebuild=True))
    elif a.command == "update":
        print(tools.build_or_update_graph(c, base=a.base))
    elif a.command == "status":
        _show(tools.list_graph_stats(c))
        branch, built = tree.branch_info(root)[0], c.store.metadata("git_branch")
        if branch and built and branch != built:
            print(f"the graph is of branch {built}, the tree of {branch}: build again")
    elif a.command == "detect-changes":
        _show(tools.detect_changes(c, a.base))
    elif a.command == "search":
        _show(tools.semantic_search_nodes(c, a.query, a.kind, a.limit).select("score", "kind", "qualified_name"), a.limit)
    elif a.command == "visualize":
        print(tools.visualize_graph(c, a.out))
    elif a.command == "postprocess":
        print(tools.postprocess(c))
    elif a.command == "wiki":
        c.wiki = a.out
        rows = community.summaries(c.graph).select(
            F.col("community_id").alias("id"), F.concat(F.lit("community "), F.col("community_id").cast("string")).alias("name"), F.lit(0.0).alias("cohesion"),
            "size", "dominant_language", F.lit(None).cast("string").alias("description"))
        print(tools.generate_wiki(c, rows))
    elif a.command == "watch":
        trigger = {"availableNow": True} if a.once else None
        if a.events or "://" not in c.store.path:  # listings of the tree are kept beside a local store
            events = watching.read_events(spark, a.events) if a.events else watching.tree_events(spark, root, f"{c.store.path}/listings")
            watching.watch(spark, events, root, c.store, f"{c.store.path}/watch", trigger, quiet_ms=settings.quiet_ms).awaitTermination()
            return 0
        folder, stop = tempfile.mkdtemp(prefix="codeloom-events-"), threading.Event()
        watching.follow(root, folder, stop, settings.quiet_ms / 1000)
        try:
            watching.watch(spark, watching.read_events(spark, f"file://{folder}"), root, c.store, f"{c.store.path}/watch", trigger, quiet_ms=settings.quiet_ms).awaitTermination()
        finally:
            stop.set()
    return 0


if __name__ == "__main__":
    sys.exit(main())
