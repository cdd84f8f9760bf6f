"""Operators of the tree library."""
