"""Pairwise similarity analytics as Spark DataFrame jobs."""
