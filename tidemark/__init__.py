"""Versioned tables, relational queries and streaming feeds on PySpark."""
