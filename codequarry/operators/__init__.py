"""Relational operators over property graphs, facts and text."""
