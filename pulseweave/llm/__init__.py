"""Operators of a training-data pipeline, each as a Spark job over a table of documents or pages.

Nothing outside this package imports it; ``registry`` lists its queries and
their SQL.
"""
