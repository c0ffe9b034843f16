"""Readers, writers and the dataset access layer."""
