"""Spark-native region, glossary, task and text analytics."""
