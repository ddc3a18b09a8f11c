"""Set-based operators over the line tables."""
