"""Loomwork: a Spark-first engine for tables of verifiable problems."""

__version__ = "0.1.0"
