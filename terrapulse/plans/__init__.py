"""Requests (lazy, one DataFrame or a few) and pipelines (jobs that write tables)."""
