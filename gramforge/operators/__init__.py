"""Operators over cells and tiles of matrices."""
