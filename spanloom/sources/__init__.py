"""Readers and writers of the tables, with their schemas."""
