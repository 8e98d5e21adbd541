"""Structured Streaming jobs. Each agrees with its batch counterpart once the stream is drained."""
