"""Operators for training data: formatting duplicates, rank aggregation, top-N, packing, leakage and spam."""
