"""Tessella: a Spark-native query engine for measurement data."""
