"""Logs as they grow, with Structured Streaming."""
