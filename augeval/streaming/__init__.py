"""Structured Streaming versions of the steps that consume the append-only response log."""
