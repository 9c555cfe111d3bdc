"""Structured Streaming: sessions, windows, thinning and duplicates over event streams, with watermarks."""
