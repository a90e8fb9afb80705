"""Spark-native analytics for market bars, fixed-horizon event contracts and training-data corpora."""
