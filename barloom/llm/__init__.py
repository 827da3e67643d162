"""Operators for preparing training text, vectors, pages and conversations at scale."""
