"""Readers, sinks and the registry of prepared tables."""
