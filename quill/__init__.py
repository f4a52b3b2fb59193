"""Spark-native document-markup analytics: markup, layout and corpus operators as DataFrame jobs."""
