"""Structured Streaming: memory feedback as it arrives."""
