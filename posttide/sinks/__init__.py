"""Stored tables and file exports."""
