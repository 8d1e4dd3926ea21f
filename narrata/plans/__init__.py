"""Narration plans: voices, runs, chunks, reuse, export, and the jobs that render them."""
