"""Matrices accumulated over streams."""
