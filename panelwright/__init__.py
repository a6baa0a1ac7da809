"""Spark-first analytics over entity-by-period panels."""
