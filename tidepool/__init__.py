"""A PySpark-native engine for interaction data: cleaning, splits, retrieval, ranking and evaluation."""

__version__ = "0.1.0"
