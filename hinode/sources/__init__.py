"""Readers, normalisers and the adapter of the driver's tables."""
