"""graphvec: graphs to vectors on Spark DataFrames."""

__version__ = "0.1.0"
