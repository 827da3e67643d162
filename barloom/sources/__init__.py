"""Readers, writers and the shapes they promise."""
