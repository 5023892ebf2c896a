"""Relational operators over vocabularies, corpora and vectors."""
