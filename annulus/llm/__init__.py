"""Operators for building language-model training corpora; nothing outside imports this package."""
