"""The same operators under Structured Streaming."""
