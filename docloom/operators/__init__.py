"""Relational and structural operators."""
