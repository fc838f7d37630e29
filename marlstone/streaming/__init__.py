"""Structured Streaming: stateful books, health, recording."""
