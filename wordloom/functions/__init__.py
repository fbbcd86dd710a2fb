"""Column-level functions: text cleaning, tokenising, vector arithmetic."""
