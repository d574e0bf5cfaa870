"""Structured Streaming folds and sinks."""
