"""Rules without state across rows, over streaming DataFrames."""

from delimlake.streaming.records import stream_records, stream_responses

__all__ = ["stream_records", "stream_responses"]
