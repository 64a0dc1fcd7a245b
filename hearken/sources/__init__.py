"""Readers and writers; every source has a declared schema."""
