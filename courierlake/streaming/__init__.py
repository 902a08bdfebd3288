"""Structured Streaming: deduplicated ingest, windows over events, and a source of numbered changes."""
