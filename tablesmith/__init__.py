"""Spark-native engine that turns web pages and documents into clean, typed tables with row-level sources."""
