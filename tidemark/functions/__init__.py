"""Column functions that need no series."""
