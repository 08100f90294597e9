"""Analyses put together from the operators."""
