"""Equity dislocation screening and point-in-time validation as Spark plans."""
