"""Part of the paperloom engine."""
