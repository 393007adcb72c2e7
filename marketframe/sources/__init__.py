"""Readers, writers and normalisers of raw feeds."""
