"""Operators of the dialogue engine."""
