"""Readers: Markdown text, folders, git snapshots, configuration, packages and the stored graph."""
