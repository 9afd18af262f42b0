"""Matrices from tables."""
