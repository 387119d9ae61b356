"""Operators over task, setting and usage tables."""
