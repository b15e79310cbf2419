"""Readers of files and of the tables between stages, and writers of the same."""
