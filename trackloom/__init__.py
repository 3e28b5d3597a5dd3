"""Spark-native analytics for object tracks, label images and intensities."""
