"""Readers, writers and lenses."""
