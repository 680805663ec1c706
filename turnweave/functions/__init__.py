"""Functions of the dialogue engine."""
