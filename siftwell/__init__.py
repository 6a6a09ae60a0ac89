"""Posting consolidation and corpus preparation as Spark DataFrame jobs."""
