"""Spark-native operators for location x day x slot demand panels, and for text corpora."""
