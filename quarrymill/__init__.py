"""Spark-native engine for cleaning, matching, merging and linking tables of named entities."""

__version__ = "0.1.0"
