"""Relational operators of screening and validation."""
