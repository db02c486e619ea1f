"""Spark-native analytics over code graphs, text chunks, vectors and event streams."""
