"""Spark-native operators for preparing and analysing large text corpora."""

__version__ = "0.1.0"
