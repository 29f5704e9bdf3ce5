"""The same state from live input, by Structured Streaming."""
