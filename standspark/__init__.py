"""Spark-native analytics for gridded observations, units, partitions and their statistics."""
