"""Retail and consumer-goods analytics as Spark DataFrame jobs."""
