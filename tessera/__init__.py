"""Spark-first preparation, summarisation and scoring of dialogue text."""
