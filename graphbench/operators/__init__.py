"""Relational graph operators."""
