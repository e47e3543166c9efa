"""Analyses that combine several operators."""
