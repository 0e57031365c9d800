"""Spark-native sensor-network analytics: Column functions, DataFrame operators, named queries and streaming jobs."""
