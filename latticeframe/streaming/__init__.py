"""Operators on streams of samples: Structured Streaming with state for each signal."""
