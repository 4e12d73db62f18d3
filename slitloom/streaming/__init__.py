"""Live focus as Structured Streaming."""
