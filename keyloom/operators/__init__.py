"""Relational operators on fact tables."""
