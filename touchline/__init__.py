"""Spark-native operators for match-forecast analytics: DataFrame in, DataFrame out."""
