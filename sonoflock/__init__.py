"""Spark-native analytics for segmented, embedded and annotated recordings."""
