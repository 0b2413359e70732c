"""Composites: digest, tours, build plan, change review."""
