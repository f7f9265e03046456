"""Marketplace analytics as Spark DataFrame jobs."""
