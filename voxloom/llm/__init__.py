"""Operators for large-scale training-data pipelines on Spark DataFrames.

Each module is one operator with a general interface; ``queries`` binds them to
the shared test tables."""
