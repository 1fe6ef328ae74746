"""Spark-native preparation and evaluation of conversational training corpora."""

__version__ = "0.1.0"
