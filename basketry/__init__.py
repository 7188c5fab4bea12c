"""basketry: scale-safe customer analytics on Spark DataFrames.

Operators take lazy DataFrames and column names and return lazy
DataFrames; see ``basketry.operators``.
"""

__version__ = "0.1.0"
