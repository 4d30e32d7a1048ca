"""Structured Streaming jobs (the like/unlike write path as a stream)."""

from contentlens.streaming.like_stream import LIKE_EVENT_SCHEMA, like_event_source, start_like_stream

__all__ = ["LIKE_EVENT_SCHEMA", "like_event_source", "start_like_stream"]
