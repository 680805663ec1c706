"""Sources of the dialogue engine."""
