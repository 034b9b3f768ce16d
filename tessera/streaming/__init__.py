"""Sequences and streams."""
