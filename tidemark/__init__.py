"""Tidemark: time-series and event analytics on PySpark."""
