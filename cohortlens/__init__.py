"""Cleaning, profiling and analysis of large flat record tables on Spark."""

from cohortlens.model import Dimension, Filter, Metric, SemanticModel, SortKey

__all__ = ["Dimension", "Filter", "Metric", "SemanticModel", "SortKey"]
