"""File batches as streams."""
