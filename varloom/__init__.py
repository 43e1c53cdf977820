"""Spark-native variant triage over whole cohorts."""
