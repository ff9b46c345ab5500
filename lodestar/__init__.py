"""Spark-native engine for filtered nearest-neighbour search over collections of vectors with attributes."""
