"""Operators for large training-data collections; nothing else in the package imports this subpackage."""
