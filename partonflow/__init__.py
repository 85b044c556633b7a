"""Event analytics on Spark DataFrames with nested particle collections."""

__version__ = "0.1.0"
