"""streaming of sessionloom."""
