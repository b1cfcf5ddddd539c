"""Schemas of the graph tables and the kinds of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KINDS = ("File", "Class", "Function", "Type", "Test")
EDGE_KINDS = ("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS", "CONTAINS", "TESTED_BY", "DEPENDS_ON", "REFERENCES")

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_EXTRA = T.MapType(_S, _S)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) < 3) for f in fields])


#: What a parser reports.
NODE_INFO = _struct(
    ("kind", _S, 0), ("name", _S, 0), ("file_path", _S, 0), ("line_start", _I, 0), ("line_end", _I, 0), ("language", _S, 0),
    ("parent_name", _S), ("params", _S), ("return_type", _S), ("modifiers", _S), ("is_test", T.BooleanType(), 0), ("extra", _EXTRA))
EDGE_INFO = _struct(
    ("kind", _S, 0), ("source_qualified", _S, 0), ("target_qualified", _S, 0), ("file_path", _S, 0), ("line", _I, 0), ("extra", _EXTRA))

#: What is stored.
NODE = _struct(
    ("id", _L, 0), ("kind", _S, 0), ("name", _S, 0), ("qualified_name", _S, 0), ("file_path", _S, 0), ("line_start", _I, 0), ("line_end", _I, 0),
    ("language", _S, 0), ("parent_name", _S), ("params", _S), ("return_type", _S), ("modifiers", _S), ("is_test", T.BooleanType(), 0),
    ("file_hash", _S), ("extra", _EXTRA), ("updated_at", T.TimestampType()), ("signature", _S), ("community_id", _L))
EDGE = _struct(
    ("id", _L, 0), ("kind", _S, 0), ("source_qualified", _S, 0), ("target_qualified", _S, 0), ("file_path", _S, 0), ("line", _I, 0),
    ("extra", _EXTRA), ("updated_at", T.TimestampType()))
METADATA = _struct(("key", _S, 0), ("value", _S))
FLOW = _struct(
    ("id", _L, 0), ("name", _S, 0), ("entry_point_id", _L, 0), ("depth", _I, 0), ("node_count", _I, 0), ("file_count", _I, 0),
    ("criticality", _D, 0), ("path", T.ArrayType(_L), 0), ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()))
MEMBERSHIP = _struct(("flow_id", _L, 0), ("node_id", _L, 0), ("position", _I, 0))
COMMUNITY = _struct(
    ("id", _L, 0), ("name", _S, 0), ("level", _I, 0), ("parent_id", _L), ("cohesion", _D, 0), ("size", _I, 0), ("dominant_language", _S),
    ("description", _S), ("created_at", T.TimestampType()))
VECTOR = _struct(("qualified_name", _S, 0), ("vector", T.ArrayType(T.FloatType()), 0), ("text_hash", _S, 0), ("provider", _S, 0))
COMMUNITY_SUMMARY = _struct(
    ("community_id", _L, 0), ("name", _S), ("purpose", _S), ("key_symbols", T.ArrayType(_S)), ("risk", _S), ("size", _I), ("dominant_language", _S))
FLOW_SNAPSHOT = _struct(
    ("flow_id", _L, 0), ("name", _S), ("entry_point", _S), ("critical_path", T.ArrayType(_S)), ("criticality", _D), ("node_count", _I), ("file_count", _I))
RISK = _struct(
    ("node_id", _L, 0), ("qualified_name", _S), ("risk_score", _D), ("caller_count", _L), ("test_coverage", _S), ("security_relevant", T.BooleanType()),
    ("last_computed", T.TimestampType()))

#: What a store derives from nodes and edges. A link is an edge as seen from one of its ends, ``name``; owner is the
#: file that the name belongs to, or the name itself. A count is of rows of one bucket of a table.
LINK = _struct(("owner", _S, 0), ("name", _S, 0), ("other", _S, 0), ("outgoing", T.BooleanType(), 0), ("kind", _S, 0), ("file_path", _S, 0), ("line", _I, 0))
COUNT = _struct(("part", _I, 0), ("counted", _S, 0), ("kind", _S), ("language", _S), ("n", _L, 0))

SCHEMA_VERSION = 6
#: What each version of the schema added: tables, and tables with new columns. Version 5 is that of the text index,
#: which is built from the nodes.
ADDED_IN: dict[int, tuple[tuple[str, ...], tuple[str, ...]]] = {
    2: ((), ("nodes",)), 3: (("flows", "memberships"), ()), 4: (("communities",), ("nodes",)), 5: ((), ()),
    6: (("community_summaries", "flow_snapshots", "risk"), ()),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, in order: older tables get nulls for columns added since."""
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
