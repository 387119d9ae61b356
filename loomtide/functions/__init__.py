"""Column functions on civil time and text."""
