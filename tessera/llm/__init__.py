"""Operators on training text and identifier sets. Nothing else in the library imports this subpackage."""
