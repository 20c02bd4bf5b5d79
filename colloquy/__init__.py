"""Spark-native analytics for meeting transcripts."""
