"""Reading, validating and writing tables, and stored model parameters."""
