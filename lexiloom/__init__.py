"""Spark-native preparation and evaluation of speech-text corpora."""
