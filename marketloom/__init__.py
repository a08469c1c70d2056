"""Marketloom: time-stamped asset panels on PySpark, in batch and in Structured Streaming."""
