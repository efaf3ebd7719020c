"""Connected components for the corpus operators: the library's star contraction, under one name."""

from annulus.operators.graph import edge_components as components

__all__ = ["components"]
