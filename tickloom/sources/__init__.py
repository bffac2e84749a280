"""Readers that give bars, and writers of results."""
