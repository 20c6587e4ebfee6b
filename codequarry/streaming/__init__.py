"""Incremental processing by Structured Streaming; an extension, since analyses are otherwise of whole snapshots."""
