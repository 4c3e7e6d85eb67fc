"""Span-and-relation annotation analytics as Spark DataFrame jobs."""
