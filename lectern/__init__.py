"""Lectern: a Spark-native analytics engine for text corpora, dictionaries and evidence graphs."""
