"""Structured Streaming counterparts of the counting operators."""
