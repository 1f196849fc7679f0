"""Versioned-record analytics on Spark.

Every operator takes and returns lazy DataFrames; see README.md for the map of modules.
"""

__version__ = "0.1.0"
