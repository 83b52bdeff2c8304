"""Compositions of operators: the full rebuild, the query registry and its SQL oracle."""
