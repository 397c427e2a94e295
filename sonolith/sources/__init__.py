"""Readers, writers and harvesters."""
