"""Compositions of operators: building a code graph, answering questions about it, keeping it up to date."""
