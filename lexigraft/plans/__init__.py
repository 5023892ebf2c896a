"""Compositions of operators: auxiliary vectors, transfer, checks."""
