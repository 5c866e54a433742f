"""Millrace: ordered-stream analytics and corpus preparation as Spark DataFrame jobs."""
