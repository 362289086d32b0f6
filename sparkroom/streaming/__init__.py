"""Sequences of frames that arrive over time."""
