"""Readers, writers and the synthetic source."""
