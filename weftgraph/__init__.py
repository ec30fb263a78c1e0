"""Spark-native call-graph analytics: refinement, projection, scoring and audits as DataFrame operators."""

__version__ = "0.1.0"
