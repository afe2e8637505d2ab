"""sources of sessionloom."""
