"""Operators for preparing training text, independent of the match feed."""
