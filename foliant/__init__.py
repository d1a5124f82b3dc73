"""foliant package."""
