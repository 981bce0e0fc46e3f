"""Readers, raw-layer shaping and writers."""
