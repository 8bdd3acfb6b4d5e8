"""Spark-native hybrid retrieval and code-graph analytics over one wide chunk table."""
