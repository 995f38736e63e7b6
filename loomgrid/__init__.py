"""Spark-native panel analytics: operators, factor expressions, evaluation and portfolio plans."""
