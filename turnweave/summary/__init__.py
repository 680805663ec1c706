"""Resumable multi-pass summaries of dialogs behind a pluggable chat client."""
