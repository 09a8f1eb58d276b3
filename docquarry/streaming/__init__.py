"""Structured Streaming: layers that grow batch by batch."""
