"""Multi-step plans that are written and read again between steps."""
