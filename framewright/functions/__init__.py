"""Column functions over feature arrays, and the range language."""
