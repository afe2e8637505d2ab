"""plans of sessionloom."""
