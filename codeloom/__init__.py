"""codeloom: a PySpark-native analytics engine for code knowledge graphs."""

__version__ = "0.1.0"
