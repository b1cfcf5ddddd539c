"""Settings, each with an environment variable of its name: CODELOOM_IMPACT_DEPTH for impact_depth, and so on."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    impact_nodes: int = 500
    impact_depth: int = 2
    flow_depth: int = 15
    search_results: int = 20
    git_seconds: int = 30
    dependent_hops: int = 2
    #: Partitions that files are parsed in; 0: as they are read.
    parse_partitions: int = 0
    #: Milliseconds without an event after which a file counts as settled.
    quiet_ms: int = 300
    #: The source tree, and where its graph is kept; empty: found from the working folder, and within the tree.
    root: str = ""
    data_dir: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Values that aren't numbers where numbers belong count as not given."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(f"CODELOOM_{f.name.upper()}", "")
            if isinstance(f.default, str):
                given[f.name] = raw
            elif raw.removeprefix("-").isdecimal():
                given[f.name] = int(raw)
        return cls(**given)

    def store_path(self, root: str) -> str:
        return f"{(self.data_dir or f'{root}/.codeloom').rstrip('/')}/graph"
