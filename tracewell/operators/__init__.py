"""Relational operators over events, processes and findings."""
