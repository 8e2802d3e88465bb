"""Incremental decoding, of one stream and as Structured Streaming state."""
