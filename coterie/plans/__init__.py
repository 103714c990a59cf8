"""Registered queries, the tables they read, and SQL for the same rows."""
