"""Structured Streaming as the vehicle of refreshes and queue drains."""
