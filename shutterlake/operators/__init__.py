"""Relational operators on catalogue tables."""
