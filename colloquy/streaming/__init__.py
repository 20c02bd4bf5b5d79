"""Structured Streaming: captions by version, deduplication, finalisation, session upserts."""
