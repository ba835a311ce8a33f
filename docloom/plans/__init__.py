"""Composed plans and their registered queries."""
