"""Tidemark: event-timeline analytics on PySpark."""
