"""Structured Streaming jobs over landed files; they share their transforms with the batch jobs."""
