"""Spark-native building and scoring of instruction-following datasets."""
