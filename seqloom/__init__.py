"""Sequence search and alignment over Spark tables."""
