"""operators of sessionloom."""
