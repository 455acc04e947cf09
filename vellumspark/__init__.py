"""Spark-native reading of document collections: scan, skim, deep reading, batches and reports over DataFrames."""

__version__ = "0.1.0"
