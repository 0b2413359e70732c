"""Incremental digests over a growing folder."""
