"""The graph: two DataFrames, and what is stored beside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Graph:
    """nodes are keyed by qualified_name; edges join them by name. An edge end without a node is legal: the raw text
    of an unresolved call, say. Operators take a Graph and return DataFrames; nothing is collected."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def edges_of(self, *kinds: str) -> DataFrame:
        return self.edges.filter(self.edges["kind"].isin(*kinds)) if kinds else self.edges
