"""A list of repositories, as JSON: path and alias."""

from __future__ import annotations

import json
from pathlib import Path


class Registry:
    def __init__(self, path: str | Path):
        self.path = Path(path)
        try:
            rows = json.loads(self.path.read_text())
            self.repos = [r for r in rows if isinstance(r, dict) and r.get("path")] if isinstance(rows, list) else []
        except (OSError, ValueError):
            self.repos = []

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(self.repos, indent=2))

    def register(self, path: str | Path, alias: str = "") -> dict:
        """Adds a folder that holds a repository or a graph; a known one gets the new alias."""
        full = Path(path).resolve()
        if not full.is_dir():
            raise ValueError(f"{full} is no folder")
        if not ((full / ".git").exists() or (full / ".codeloom").exists()):
            raise ValueError(f"{full} holds neither a repository nor a graph")
        known = self.by_path(full)
        if known:
            known["alias"] = alias or known.get("alias", "")
        else:
            known = {"path": str(full), "alias": alias}
            self.repos.append(known)
        self._save()
        return known

    def unregister(self, path_or_alias: str) -> bool:
        full = str(Path(path_or_alias).resolve())
        kept = [r for r in self.repos if r["path"] != full and (r.get("alias") or None) != path_or_alias]
        gone = len(kept) < len(self.repos)
        if gone:
            self.repos = kept
            self._save()
        return gone

    def list(self) -> list[dict]:
        return list(self.repos)

    def by_alias(self, alias: str) -> dict | None:
        return next((r for r in self.repos if alias and r.get("alias") == alias), None)

    def by_path(self, path: str | Path) -> dict | None:
        full = str(Path(path).resolve())
        return next((r for r in self.repos if r["path"] == full), None)

    def resolve(self, name: str = "") -> Path:
        """The path of an alias, a folder of that name, or the current folder."""
        known = self.by_alias(name)
        if known:
            return Path(known["path"])
        return Path(name).resolve() if name and Path(name).is_dir() else Path.cwd()
