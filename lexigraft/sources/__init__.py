"""Readers, writers and the compute-or-load cache."""
