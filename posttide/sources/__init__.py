"""Readers for landed pages, feeds, posts, labeled files and stored tables."""
