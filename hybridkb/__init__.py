"""Spark-native knowledge-base retrieval: distil pages, index them, rank them, keep them fresh."""

__version__ = "0.1.0"
