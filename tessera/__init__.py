"""Spark-native analytics for training corpora, evaluations and experiment registries."""
