"""From expression text to staged DataFrame plans."""
