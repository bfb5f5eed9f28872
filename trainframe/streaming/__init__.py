"""Structured Streaming: growing files and stream-safe operators."""
