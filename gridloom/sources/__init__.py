"""Reading logs and writing tables."""
