"""Incremental ingest of Markdown folders (an extension)."""
