"""Reports."""
