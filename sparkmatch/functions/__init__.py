"""Graph statistics and column expressions."""
