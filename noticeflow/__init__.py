"""Spark-native tracking of published notices: ingest, normalise, compare, merge, report."""
