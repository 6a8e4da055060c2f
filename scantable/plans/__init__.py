"""Composite queries and their SQL counterparts."""
