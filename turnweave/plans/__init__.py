"""Plans of the dialogue engine."""
