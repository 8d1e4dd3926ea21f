"""Operators over tables of blocks, spans, suggestions, chapters and revisions."""
