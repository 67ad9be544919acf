"""Compositions of operators into whole screens and replays."""
