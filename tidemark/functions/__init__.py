"""Column functions on tags and text."""
