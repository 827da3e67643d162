"""Feature groups and table operators."""
