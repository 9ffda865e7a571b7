"""Structured Streaming: statistics kept per domain as rows arrive."""
