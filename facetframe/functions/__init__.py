"""See the README for what this package holds."""
