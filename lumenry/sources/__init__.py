"""Readers and writers of caption tables."""
