"""PySpark-native analytics for observability data: evidence, joint laws, bounds and scores."""
