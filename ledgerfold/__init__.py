"""ledgerfold: set-oriented analytics over append-only mutation logs, on Spark DataFrames."""

__version__ = "0.1.0"
