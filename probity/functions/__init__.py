"""Part of the probity engine."""
