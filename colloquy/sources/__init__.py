"""Readers: caption exports, transcripts and notes, and adapters from relational tables."""
