"""Seeded populations and labelled scenarios."""
