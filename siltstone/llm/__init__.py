"""Operators for large text corpora: one module per operator, each a set of Spark jobs."""
