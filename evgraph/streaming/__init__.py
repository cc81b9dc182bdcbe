"""Streaming: the work queue and event-time windows."""
