"""Streaming of the dialogue engine."""
