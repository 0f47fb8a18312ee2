"""Causal operators on streams of blocks."""
