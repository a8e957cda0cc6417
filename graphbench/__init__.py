"""Property-graph analytics and question-benchmark processing on Spark DataFrames."""

__version__ = "0.1.0"
