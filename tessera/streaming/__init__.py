"""Structured Streaming extensions: incremental index maintenance and windowed latency."""
