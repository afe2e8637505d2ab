"""functions of sessionloom."""
