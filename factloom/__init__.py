"""PySpark-native structural code analytics: facts, graph-pattern queries, review and evaluation."""
