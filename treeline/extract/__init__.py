"""Symbols and imports from source texts, and scaffolds."""
