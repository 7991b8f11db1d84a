"""Structured Streaming: run logs and keyed state."""
