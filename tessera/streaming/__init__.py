"""Streaming: progress and generated tokens."""
