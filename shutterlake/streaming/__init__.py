"""Structured Streaming jobs.  Every sink is idempotent per batch."""
