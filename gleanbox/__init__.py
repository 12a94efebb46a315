"""Spark jobs over transactional-outbox tables."""
