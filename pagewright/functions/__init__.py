"""Column functions over text, dates and paths."""
