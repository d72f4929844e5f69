"""Operators on collections, parses and transforms."""
