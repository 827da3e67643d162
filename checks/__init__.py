"""Inputs and oracle queries over the provided test tables."""
