"""Table-at-a-time operators."""
