"""Relational, similarity and frame operators."""
