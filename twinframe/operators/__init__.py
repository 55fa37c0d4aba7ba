"""Operators over graphs."""
