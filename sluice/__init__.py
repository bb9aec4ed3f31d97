"""Sluice: a Spark-native engine that turns landed web pages, JSON payloads and crawl logs into tables."""

__version__ = "0.1.0"
