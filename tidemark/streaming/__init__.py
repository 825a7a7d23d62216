"""Structured Streaming: bars from ticks and alerts on them."""
